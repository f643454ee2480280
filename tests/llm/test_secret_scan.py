import random
import re

from cradlemart.llm.secret_scan import RULES, BlobLedger, Rule, scan_versions, span_text

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def texts():
    rnd = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "abc", "abcdef", "é", "😀",
             "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "A", "x.y/z"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(300)]
    return [None, "", "a", "token=" + "a" * 50_000, *out, *out[:40]]


def test_base_as_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "secret=abcdefg")]
    docs = spark.createDataFrame([(i, t, "k", "b") for i, t in rows], "doc_id long, text string, kind string, blob string")
    got = {r.path: r.t for r in scan_versions(docs, rules=RULES[:3]).select("path", span_text("spans").alias("t")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == brute(t), t


def test_ledger_scans_only_new_pairs(spark, tmp_path):
    ledger = BlobLedger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([("a@1", "token=abcdef"), ("b@1", "token=abcdef"), ("a@2", "none")], "doc_id string, text string")
    second = first.union(spark.createDataFrame([("c@1", "secret: 123456")], "doc_id string, text string"))
    assert scan_versions(first, ledger, rules=RULES[:1]).count() == 3
    assert ledger.rows().count() == 2
    scan_versions(second, ledger, rules=RULES[:1])
    assert ledger.rows().count() == 3
    got = scan_versions(second, ledger, rules=(Rule("assign", 2, "none", "none"), RULES[1]))
    assert ledger.rows().count() == 9  # a new version and a new rule for all three blobs
    assert {r.path: len(r.spans) for r in got.collect()} == {"a@1": 0, "b@1": 0, "a@2": 1, "c@1": 0}


def test_empty(spark):
    assert scan_versions(spark.createDataFrame([], "doc_id long, text string")).count() == 0
