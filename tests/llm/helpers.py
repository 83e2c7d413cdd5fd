"""Brute-force versions and small tables for the tests of this folder."""

from __future__ import annotations

import duckdb

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def docs_of(spark, texts, **extra):
    """documents rows 0, 1, ... with the given texts."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark, name="documents"):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns whose
    names clash with those that the operators use inside."""
    long_text = "lorem ipsum dolor sit amet " * 8000
    texts = ["", None, "one", "a b c d e f g", "a b c d e f g", long_text, "x\n\n\ny", "\U0001d518́ é\u0000 ▁ 你好", "1" * 3000 + "@" * 2000, ">" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (None, None), (3, "a b c d e f g"), (3, "another text, same id")]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "x", k, None, ["y"], 1.5, 2) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, text_key string, h int, fp string, lines array<string>, score double, removed int",
    )


def duck(query, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame.toArrow())
    rel = con.sql(query)
    return rel.columns, rel.fetchall()


def norm(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(fix(v) for v in r)) for r in rows)


def same_as_oracle(frame, query, **frames):
    cols, rows = duck(query, **frames)
    order = [cols.index(c) for c in frame.columns]
    assert sorted(cols) == sorted(frame.columns)
    assert norm(frame.collect()) == norm([tuple(r[i] for i in order) for r in rows])


def components(values, linked):
    """Smallest-id components by comparing all pairs: {id: smallest id}."""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
