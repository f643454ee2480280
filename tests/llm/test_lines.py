import random
from collections import defaultdict

from pyspark.sql import functions as F

from cradlemart.llm.lines import LineRuns, drop_repeated_lines

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, least=3, length=20):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(SPACES))
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < length or len(holders[key(x)]) < least or max(holders[key(x)]) == rank(i)]
        out.append((rank(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(frame):
    return sorted((-1 if r.id is None else r.id, r.n_lines, r.n_dropped, r.kept_text) for r in frame.collect())


def test_as_brute_force(spark):
    rnd = random.Random(7)
    pool = [f"a line that many documents have, number {k}" for k in range(30)] + ["short", "", "Ünïcödé line of twenty points é", "   "]
    dress = lambda x: rnd.choice([x, x.upper() if x.isascii() else x, f"\t {x}\r", f"{x}\x0b"])
    text = lambda: "\n".join(dress(rnd.choice(pool[: rnd.choice((3, 34))])) for _ in range(rnd.randint(0, 12)))
    rows = [(i, text()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, (pool[0] + "\n") * 3000), (204, "x" * 300_000), (205, "X" * 300_000), (206, "x" * 300_000)]
    rows += [(3, pool[1]), (3, pool[1]), (None, pool[2]), (None, pool[3]), (-5, pool[4])]  # ids that come again, null and negative ids
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, h1 int, lost string, batch int")
    for batches, fanout in ((1, 2), (6, 3), (5, 2)):
        assert got(drop_repeated_lines(docs, batches=batches, fanout=fanout)) == brute(rows)


def test_only_in_repeated_rows_of_one_document(spark):
    line = "the same line in one document only"
    docs = spark.createDataFrame([(1, line), (1, line), (1, line), (2, line)], "doc_id long, text string")
    assert got(drop_repeated_lines(docs)) == [(1, 1, 0, line)] * 3 + [(2, 1, 0, line)]


def test_runs_are_compacted_and_settled_keys_stay_out(spark):
    index = LineRuns(least=2, fanout=3)
    sizes = []
    for start in (40, 30, 20, 10, 0):  # falling ids: what is settled stays so
        ids = spark.range(start, start + 10)
        entries = ids.select("id", F.lit(1).cast("bigint").alias("h1"), F.lit(1).cast("bigint").alias("h2"))
        entries = entries.unionByName(ids.select("id", F.col("id").alias("h1"), F.lit(2).cast("bigint").alias("h2")))
        sizes.append(index.add(entries).count())
    assert sizes == [11, 10, 10, 10, 10]
    assert [len(level) for level in index.levels] == [2, 1]
    assert [tuple(r) for r in index.frequent().collect()] == [(1, 1, 49)]
    index.add(spark.createDataFrame([(99, 1, 1)], "id long, h1 long, h2 long"))  # a later document takes the line over
    assert [tuple(r) for r in index.frequent().collect()] == [(1, 1, 99)]


def test_empty(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
