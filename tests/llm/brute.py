"""Plain Python counterparts for the tests of this folder."""


def groups(nodes, pairs):
    """Each node's smallest reachable node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def spark_rows(df):
    return sorted(tuple(r) for r in df.collect())
