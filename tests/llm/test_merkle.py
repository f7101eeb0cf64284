import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rigflow.llm import merkle_manifest as M
from tests.llm.conftest import DOCS, EDGE, SF


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """Root of a list of hashes, and for each of them its siblings (before, after) on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for p, k in zip(paths, at):
            p.append(("".join(runs[k // 8][:k % 8]), "".join(runs[k // 8][k % 8 + 1:])))
        at, nodes = [k // 8 for k in at], [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    by_lang = {}
    for d, t, lang, s, n in rows:
        changed = t if d is None or t is None or zlib.crc32(str(d).encode()) % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        by_lang.setdefault(lang, []).append(((d is not None, d or 0), leaf(d, s, lang, n, t), leaf(d, s, lang, n, changed), d))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs = {x: tree([r[1] for r in sorted(by_lang[x], key=lambda r: r[:2])]) for x in langs}
    root, above = tree([subs[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above):
        for (_, own, f, d), path in zip(sorted(by_lang[x], key=lambda r: r[:2]), subs[x][1]):
            for a, b in path + up:
                f = h(a, f, b)
            out.append((d, own, subs[x][0], root, h(*[a + b for a, b in path + up]), f, f == root))
    return sorted(out, key=str)


def result(spark, docs):
    rows, root = M.manifest(docs)
    folded = M.fold(F.coalesce("tampered", "hash"), F.col("path"))
    got = rows.select("doc_id", "hash", "subroot", F.lit(root).alias("root"), M.proof_hash(F.col("path")).alias("p"), folded.alias("f"))
    return sorted([(*r, r.f == root) for r in got.collect()], key=str)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_shape_of_tree(spark):
    """Languages of 1, 7, 8, 9, 64, 65, 513 and 4,500 leaves, over eight of them."""
    sizes = {None: 9, "": 1, "a": 7, "b": 8, "c": 64, "d": 65, "é": 513, "z": 4_500, "zz": 1, "日": 2}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7919 % 100_003, f"Text {i} É" if i % 11 else None, lang, "s" if i % 5 else None, i))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = result(spark, docs.repartition(5))
    assert got == brute(rows) and any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_nulls_ties_repeats_and_extra_columns(spark, edge, empty):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in EDGE]
    got = result(spark, edge.withColumns({"hash": F.lit(1), "place": F.lit(2), "tree": F.lit("x"), "path": F.lit(3)}))
    assert got == brute(rows)
    assert result(spark, empty) == []


def test_one_row(spark):
    rows = [(5, "ABC", "en", "s", 3)]
    got = result(spark, spark.createDataFrame([(5, "ABC", "en", "s", 3, None, None, None, None)], DOCS))
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("sf", [SF])
def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = M.op13_merkle_manifest(spark, sf)
    got = sorted(map(tuple, df.collect()))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    assert got == sorted(brute(docs))
    sql = con.sql(M.OP13_SQL)
    assert sql.columns == df.columns and sorted(sql.fetchall()) == got


def test_plan_keeps_texts_out_of_every_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = M.manifest(docs)[0]._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
