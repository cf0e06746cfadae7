"""Model tables derived from the given tables.

Every view exists twice: as a DataFrame, and in ``VIEWS`` as the SQL another engine runs on the
same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.frames import spread
from lorespark.operators.wiki import build_index
from lorespark.plans.wiki_views import START, WIKI_NEEDS, WIKI_VIEWS
from lorespark.session import durable

# The query texts asked of every knowledge base.
QUERY_TEXTS = ["the and", "of in that", "la de", "under von", "zzzz"]
# Ignore patterns for the path listing.
IGNORE = ["*.log", "build/", "ad*", "t?mp", "[xq]*"]
PAGE_TYPE_CYCLE = ["entity", "concept", "summary", "comparison", "synthesis"]
PHASE_CYCLE = ["initialize", "read_source", "chunk", "embed", "integrate_wiki", "finalize"]


class Model:
    """The derived tables at one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def spread_pages(self) -> DataFrame:
        return spread(self.table("pages"), "page_id")

    def spread_documents(self) -> DataFrame:
        """For per-row text work: a single-file table still uses all cores."""
        columns = self.documents().select("doc_id", "text", "lang", "source")
        return spread(columns, "doc_id")

    def size(self, name: str) -> Column:
        """Row count of a table as a scalar sub-query."""
        return self.table(name).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()

    def kbs(self) -> DataFrame:
        return self.documents().groupBy(F.col("source").alias("kb_id")).agg(
            F.concat(F.lit("kb "), F.first("source")).alias("name"),
            minute(F.min("doc_id")).alias("created_at"),
        )

    def contents(self) -> DataFrame:
        return self.spread_documents().select(
            F.col("doc_id").cast("string").alias("source_id"),
            F.col("source").alias("kb_id"),
            F.lit(0).alias("part"),
            "text",
            F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        )

    def code(self) -> DataFrame:
        ext = F.element_at(
            F.array(*[F.lit(x) for x in (".py", ".js", ".ts", ".txt")]),
            (F.col("doc_id") % 4 + 1).cast("int"),
        )
        n = F.col("doc_id").cast("string")
        text = F.when(
            F.col("doc_id") % 4 == 0,
            F.concat(
                F.lit("import os\n\nclass C"), n, F.lit(":\n    pass\n\ndef f"), n,
                F.lit("():\n    x = '''"), F.col("text"), F.lit("'''\n    return 1\n"),
            ),
        ).otherwise(
            F.concat(
                F.lit("// "), n, F.lit("\nclass C"), n,
                F.lit(" {}\n\nexport async function f"), n, F.lit("() {\n/*\n"), F.col("text"),
                F.lit("\n*/\n}\nexport class E"), n, F.lit(" {}\n"),
            )
        )
        path = F.concat(F.lit("src/f"), n, ext)
        return self.spread_documents().select(
            n.alias("source_id"),
            F.col("source").alias("kb_id"),
            F.lit(0).alias("part"),
            text.alias("text"),
            F.create_map(F.lit("file_path"), path).alias("metadata"),
        )

    def pages(self, suffix: bool = True, wide: bool = True) -> DataFrame:
        """Wiki pages; ``suffix`` adds the wikilink, without it contents repeat."""
        d = F.col("doc_id")
        target = F.when(d % 3 == 1, d + 7).otherwise(d + 20 * (1 + d % 7))
        content = F.concat(F.col("text"), F.lit(" [[Doc "), target.cast("string"), F.lit("]]"))
        kind = F.element_at(F.array(*[F.lit(t) for t in PAGE_TYPE_CYCLE]), (d % 5 + 1).cast("int"))
        base = self.spread_documents() if wide else self.documents()
        return base.select(
            d.cast("string").alias("page_id"),
            F.col("source").alias("kb_id"),
            F.concat(F.lit("Doc "), d.cast("string")).alias("title"),
            (content if suffix else F.col("text")).alias("content"),
            kind.alias("page_type"),
            F.array("lang").alias("tags"),
            minute(d).alias("created_at"),
            (minute(d) + F.expr("make_dt_interval(cast(doc_id % 10 as int))")).alias("updated_at"),
        )

    def indexed_pages(self) -> DataFrame:
        """Wiki pages with a stored index: right for half of the kbs, absent for some.

        Written out, as the pages table of a running wiki would be.
        """
        pages = self.pages(wide=False)
        number = F.substring("kb_id", 4, 9).cast("int")
        seen = pages.filter((number % 2 == 0) | (F.col("page_id").cast("long") % 50 != 0))
        index = build_index(seen.filter(number % 7 != 3)).select(
            F.concat(
                F.lit("index-"),
                "kb_id",
                F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string")))
                .otherwise(""),
            ).alias("page_id"),
            "kb_id",
            "title",
            "content",
            F.lit("index").alias("page_type"),
            F.array().cast("array<string>").alias("tags"),
            minute(F.lit(0)).alias("created_at"),
            minute(F.lit(0)).alias("updated_at"),
        )
        return durable(self.pages().unionByName(index))

    def links(self) -> DataFrame:
        d = F.col("doc_id")
        return (
            self.documents()
            .filter(d % 3 != 0)
            .select(
                d.cast("string").alias("from_page_id"),
                ((d * 7 + 3) % self.size("documents")).cast("string").alias("to_page_id"),
            )
        )

    def sources(self) -> DataFrame:
        s = F.col("s_suppkey")
        return (
            self.table("supplier")
            .filter(s % 11 != 0)
            .select(
                s.cast("string").alias("source_id"),
                F.concat(F.lit("src"), (s % 5).cast("string")).alias("kb_id"),
                F.lit("file").alias("source_type"),
                F.col("s_name").alias("uri"),
                F.create_map().cast("map<string,string>").alias("metadata"),
                F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
                F.lit(0).alias("chunk_count"),
                F.lit("pending").alias("status"),
            )
        )

    def page_sources(self) -> DataFrame:
        d = F.col("doc_id")
        width = F.greatest(F.lit(1), F.floor(self.size("supplier") * 3 / 4))
        return self.documents().select(
            d.cast("string").alias("page_id"), (d % width).cast("string").alias("source_id")
        )

    def doc_sources(self) -> DataFrame:
        """Each document as a source of its knowledge base."""
        n = F.col("doc_id").cast("string")
        return self.documents().select(
            n.alias("source_id"),
            F.col("source").alias("kb_id"),
            F.lit("file").alias("source_type"),
            F.concat(F.lit("doc/"), n, F.lit(".txt")).alias("uri"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
            F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
            F.lit(0).alias("chunk_count"),
            F.lit("ingesting").alias("status"),
        )

    def queries(self) -> DataFrame:
        """Every query text for every knowledge base."""
        texts = F.array(*[F.lit(t) for t in QUERY_TEXTS])
        kbs = self.documents().select(F.col("source").alias("kb_id")).distinct()
        return kbs.select("kb_id", F.posexplode(texts).alias("q", "text")).select(
            F.concat_ws(":", "kb_id", F.col("q").cast("string")).alias("query_id"), "kb_id", "text"
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("vec_id"),
            F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb_id"),
            "embedding",
            F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("document"),
            F.create_map(
                F.lit("shelf"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string"))
            ).alias("metadata"),
        )

    def vector_queries(self) -> DataFrame:
        """Every vector asks for its neighbours."""
        return self.vectors().select(
            F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), "kb_id", "embedding"
        )

    def run_events(self) -> DataFrame:
        status = F.create_map(
            *[
                F.lit(x)
                for pair in (
                    ("click", "running"),
                    ("signup", "running"),
                    ("view", "completed"),
                    ("purchase", "completed"),
                    ("error", "failed"),
                )
                for x in pair
            ]
        )
        phase = F.element_at(
            F.array(*[F.lit(p) for p in PHASE_CYCLE]), (F.col("event_id") % 6 + 1).cast("int")
        )
        return self.table("events").select(
            F.col("user_id").cast("string").alias("run_id"),
            F.concat(F.lit("kb"), (F.col("user_id") % 5).cast("string")).alias("kb_id"),
            F.lit(None).cast("string").alias("source_id"),
            F.col("event_id").alias("seq"),
            phase.alias("phase"),
            status[F.col("event_type")].alias("status"),
            "ts",
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"),
        )

    def commits(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("role").alias("repo"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sha"),
            F.initcap("role").alias("author"),
            F.concat("role", F.lit("@example.com")).alias("email"),
            (minute(F.col("conv_id")) + F.expr("make_dt_interval(0, 0, 0, turn)")).alias("date"),
            F.concat(F.lit("\n"), "text", F.lit(" \n")).alias("message"),
        )

    def changes(self) -> DataFrame:
        """Line items of an order as the files changed in the turns of a conversation."""
        later = self.table("conversations").filter("turn > 0").select("conv_id", "turn", "role")
        kind = F.create_map(*[F.lit(x) for x in ("A", "A", "N", "M", "R", "R")])
        return later.join(self.table("lineitem"), F.col("conv_id") == F.col("l_orderkey")).select(
            F.col("role").alias("repo"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sha"),
            (F.col("l_linenumber") - 1).alias("ord"),
            kind[F.col("l_returnflag")].alias("change_type"),
            F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("a_path"),
            F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("b_path"),
        )

    def paths(self) -> DataFrame:
        """Paths from page urls under prefixes that are hidden, excluded or plain."""
        prefixes = ["", ".hidden/", "build/", "node_modules/", "docs/", "t1mp/"]
        tails = ["a.txt", "b.log", "x.md", ".env"]
        p = F.col("page_id")

        def pick(values: list[str], at: Column) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

        tail = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/+$", "")
        return self.table("pages").select(
            p.cast("string").alias("source_id"),
            F.concat(
                pick(prefixes, p % 6), tail, F.lit("/"), pick(tails, F.floor(p / 6) % 4)
            ).alias("rel_path"),
        )

    def responses(self) -> DataFrame:
        """Documents as fetched responses, some JSON, some failed, some empty."""
        d = F.col("doc_id")
        body = F.when(d % 7 == 3, F.lit("")).when(
            d % 3 == 0,
            F.concat(F.lit('{"id": '), d.cast("string"), F.lit(', "lang": ["'), "lang", F.lit('"]}')),
        ).otherwise(F.col("text"))
        return self.spread_documents().select(
            F.concat(F.lit("http://api.example.com/"), d.cast("string")).alias("url"),
            F.when(d % 5 == 4, 404).otherwise(200).alias("status_code"),
            F.when(d % 3 == 0, "application/json").otherwise("text/plain").alias("content_type"),
            body.alias("body"),
        )


def minute(n: Column) -> Column:
    """2024-01-01 plus ``n`` minutes, without a time zone."""
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    days, rest = F.floor(n / 1440).cast("int"), (n % 1440).cast("int")
    return start + F.make_dt_interval(days, F.lit(0), rest)


def _case(key: str, values: list[str]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {key} {whens} end"


VIEWS = {
    "m_kbs": f"""
        select source as kb_id, 'kb ' || source as name,
               {START} + to_minutes(min(doc_id)) as created_at
        from documents group by source""",
    "m_contents": """
        select doc_id::varchar as source_id, source as kb_id, 0 as part, text, lang
        from documents""",
    "m_pages": f"""
        select doc_id::varchar as page_id, source as kb_id, 'Doc ' || doc_id as title,
               text || ' [[Doc ' || (case when doc_id % 3 = 1 then doc_id + 7
                 else doc_id + 20 * (1 + doc_id % 7) end) || ']]' as content,
               {_case('doc_id % 5', PAGE_TYPE_CYCLE)} as page_type,
               lang as tag,
               {START} + to_minutes(doc_id) as created_at,
               {START} + to_minutes(doc_id) + to_days((doc_id % 10)::int) as updated_at,
               text
        from documents""",
    "m_links": """
        select distinct doc_id::varchar as from_page_id,
               ((doc_id * 7 + 3) % (select count(*) from documents))::varchar as to_page_id
        from documents where doc_id % 3 <> 0""",
    "m_sources": """
        select s_suppkey::varchar as source_id, 'src' || (s_suppkey % 5) as kb_id,
               'file' as source_type, s_name as uri
        from supplier where s_suppkey % 11 <> 0""",
    "m_page_sources": """
        select doc_id::varchar as page_id,
               (doc_id % greatest(1, (select count(*) from supplier) * 3 // 4))::varchar as source_id
        from documents""",
    "m_queries": f"""
        select kb_id || ':' || q as query_id, kb_id, text
        from (select distinct source as kb_id from documents),
             (values {', '.join(f"({i}, '{t}')" for i, t in enumerate(QUERY_TEXTS))}) t(q, text)""",
    "m_vectors": """
        select vec_id::varchar as vec_id, 'kb' || label as kb_id, embedding::double[] as embedding,
               's' || (vec_id % 4) as shelf
        from embeddings""",
    "m_vector_queries": """
        select 'q' || vec_id as query_id, kb_id, embedding from m_vectors""",
    "m_run_events": f"""
        select user_id::varchar as run_id, 'kb' || (user_id % 5) as kb_id, event_id as seq,
               {_case('event_id % 6', PHASE_CYCLE)} as phase, event_id % 6 as pos,
               case event_type when 'click' then 'running' when 'signup' then 'running'
                 when 'view' then 'completed' when 'purchase' then 'completed'
                 when 'error' then 'failed' end as status,
               ts, 'event ' || event_id as error
        from events""",
}
VIEWS.update(WIKI_VIEWS)
VIEW_NEEDS = {"m_vector_queries": ["m_vectors"], **WIKI_NEEDS}


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views (and what they need) defined before it."""
    order: list[str] = []
    for name in names:
        for need in [*VIEW_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    if not head:
        return body.strip()
    body = body.strip()
    start = "with recursive " if body.startswith("with recursive ") else "with "
    joiner = ",\n" + body.removeprefix(start) if body.startswith("with ") else "\n" + body
    return f"{start}{head}{joiner}"
