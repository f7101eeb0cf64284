import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rigflow.llm import prefix_trie as T
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth string, at string, k0 string"


def brute(rows, block=100, most=6):
    """rows: (conv_id, turn, role, text)"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            tie = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    again = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % block if c >= 0 else -(abs(c) % block))
        again[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in again.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        out = [p]
        for q in children.get(p, []):
            out += below(q)
        return out

    out = []
    for p, cs in members.items():
        sub = below(p)
        ends = ",".join(map(str, sorted(c for c in cs if len(again[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), sum(q not in children for q in sub),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def test_the_tree_grows_through_every_layout():
    """One to 256 children of a node, cut runs, keys that end inside a run."""
    r = random.Random(1)
    for n in (1, 4, 5, 16, 17, 48, 49, 200, 256):
        tree = T.RadixTree()
        keys = [bytes([b]) + b"\x00" * 15 + bytes([r.randrange(3)]) * 16 * r.randrange(3) for b in r.sample(range(256), n)]
        keys += [b"", keys[0], keys[0] + b"\x07" * 16, keys[0][:16]]
        for i, k in enumerate(keys):
            tree.insert(k, 1000 - i)
        want = {}
        for i, k in enumerate(keys):
            for d in range(1, len(k) // 16 + 1):
                m = want.setdefault(k[:16 * d], [0, 10**9])
                m[0], m[1] = m[0] + 1, min(m[1], 1000 - i)
        got = {b"".join(path[:length]): [members, least] for length, _, members, least, path in tree.prefixes()}
        assert got == want and tree.root.members == len(keys)
        rooms = tree.root.children.room
        assert rooms >= n and (n > 4 or rooms == 4) and rooms in (4, 16, 48, 256)


@pytest.mark.parametrize("width", [1, 2, 16])
def test_random_keys_of_any_width(width):
    r = random.Random(width)
    for _ in range(50):
        ids = [bytes(r.randrange(3) for _ in range(width)) for _ in range(4)]
        keys = [b"".join(r.choice(ids) for _ in range(r.randrange(6))) for _ in range(40)]
        tree = T.RadixTree()
        for i, k in enumerate(keys):
            tree.insert(k, i)
        got = {b"".join(path[:n]): (members, least) for n, _, members, least, path in tree.prefixes(width)}
        want = {}
        for i, k in enumerate(keys):
            for d in range(width, len(k) + 1, width):
                m = want.get(k[:d], (0, i))
                want[k[:d]] = (m[0] + 1, m[1])
        assert got == want


def rows_of(seed: int, convs: int):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 650), convs):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None, ""]), r.choice(["a", "bb", "é🙂", None, ""])))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "y", "z") for row in rows], SCHEMA)


def test_against_brute_force_with_small_segments_and_trees(spark, monkeypatch):
    """Segments of 4 turns, trees of 16 segments, strings of 3 ids: the parts meet as one."""
    monkeypatch.setattr(T, "SEGMENT", 4)
    monkeypatch.setattr(T, "TREE", 16)
    monkeypatch.setattr(T, "CHUNK", 3)
    rows = rows_of(1, 250) + [(700, t, "u", str(t % 7)) for t in range(60)] + [(701, t, "u", str(t % 7)) for t in range(61)]
    assert result(T.prefix_trie(frame(spark, rows).repartition(4))) == brute(rows)


def test_nulls_ties_repeats_empty(spark):
    rows = [(None, 0, "u", "x"), (0, None, "u", "first"), (0, 1, None, None), (0, 1, None, None), (0, 1, "", "b"), (3, 5, "u", "t" * 50_000), (3, 5, "u", "t" * 50_000),
            (5, 0, "u", "only"), (200, None, None, "z"), (207, 1, "a", "b"), (-3, 0, "u", "neg"), (-103, 2, "u", "neg")]
    assert result(T.prefix_trie(frame(spark, rows))) == brute(rows)
    assert result(T.prefix_trie(frame(spark, []))) == []
    assert result(T.prefix_trie(frame(spark, [(None, 1, "u", "x")]))) == []


def test_query_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = T.op11_prefix_trie(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(df)
    assert got == brute(rows)
    sql = con.sql(T.OP11_SQL)
    assert sql.columns == df.columns and sorted(sql.fetchall()) == got


def test_names_are_equal_in_spark_and_in_the_tree(spark):
    """The sums that Spark takes over turns are those that a walk through the tree takes."""
    df = spark.createDataFrame([(0, b"\x01" * 16), (1, b"\xfe" * 16)], "at long, id binary")
    parts = df.select(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(T._parts(F.col("at"), F.col("id")))]).first()
    walked = T._step(T._step((0,) * T.LIMBS, 0, b"\x01" * 16), 1, b"\xfe" * 16)
    assert tuple(x & 0xFFFFFFFF for x in parts) == walked
