import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import counts, digest, multiset, ordered, quantiles, redact, text
from docquarry.operators import semantic

ODD = "\x1c\u2003 a\u00a0b\x85c\u3000\n"


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("value", [ODD, "", "  ", "x", "\ta b\u202fc\x1f", "é\u1680ß"])
def test_whitespace_follows_python(spark, value):
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.tokens) == value.split()
    assert one(spark, value, text.is_blank) == (not value.strip())
    assert one(spark, value, text.collapse_whitespace) == " ".join(value.split())


@pytest.mark.parametrize(
    "value, want",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("a\r\n\r\n\r\nb \n", "a\n\nb"),
        (None, ""),
        (" \n ", ""),
    ],
)
def test_newlines(spark, value, want):
    assert one(spark, value, text.normalise_newlines) == want


def test_preview(spark):
    assert one(spark, "abc", lambda c: text.preview(c, 3)) == "abc"
    assert one(spark, "abcd", lambda c: text.preview(c, 3)) == "abc... [truncated]"
    assert one(spark, None, lambda c: text.preview(c, 3)) == ""


@pytest.mark.parametrize(
    "path, want",
    [("/a/b.PDF", ".pdf"), ("x.tar.docx", ".docx"), (".pdf", ""), ("a/.doc", ""), ("a.b/c", ""), ("a.", "")],
)
def test_extension(spark, path, want):
    assert one(spark, path, text.file_extension) == want


def test_structured_text_skips_absent_parts(spark):
    df = spark.createDataFrame(
        [(" body ", "f.docx", "", 3, "section"), ("b", None, "S", None, "pdf")],
        "t string, s string, h string, p int, d string",
    )
    got = [r[0] for r in df.select(text.structured_text(*[F.col(c) for c in "tshpd"])).collect()]
    assert got == ["Source: f.docx\nPage: 3\nContent Type: section\nbody", "Section: S\nb"]


@pytest.fixture(scope="module")
def groups(spark):
    rnd = random.Random(5)
    data = [
        (k, p * rnd.choice([1, 1, 1]) + 3, rnd.choice([None, "a", "b"]), rnd.randint(0, 4))
        for k, n in (("hot", 60), ("cold", 3), ("one", 1))
        for p in sorted(rnd.sample(range(200), n))
    ]
    return spark.createDataFrame(data, "k string, pos long, v string, n long")


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_running_values_equal_plain_windows(groups, rows, block):
    w = Window.partitionBy("k").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    want = groups.select(
        "k",
        "pos",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("total"),
        (F.row_number().over(w) - 1).cast("long").alias("place"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fill"),
        F.collect_list("n").over(w.rowsBetween(-4, -1)).alias("recent"),
        F.lag("v").over(w).alias("before"),
    )
    got = ordered.running_total(groups, ["k"], "pos", F.col("n"), "total", block=block)
    got = ordered.dense_rank_along(got, ["k"], "pos", "place", block=block)
    got = ordered.fill_forward(got, ["k"], "pos", F.col("v"), "fill", block=block)
    got = ordered.recent_values(got, ["k"], "pos", F.col("n"), 4, "recent", block=block)
    got = ordered.previous_value(got, ["k"], "pos", F.col("v"), "prev", block=block)
    got = got.select("k", "pos", "total", "place", "fill", "recent", F.get("prev", F.lit(0)).alias("before"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("block,levels", [(1, 1), (3, 1), (3, 3), (2, 4), (10_000, 2)])
def test_values_of_one_pass_equal_plain_windows(spark, rows, block, levels):
    rnd = random.Random(block)
    data = [
        (k, p, rnd.choice([None, None, "a", "b"]), rnd.choice([None, 1, 5]))
        for k, n, most in (("hot", 90, 200), ("sparse", 20, 10**15), (None, 4, 9), ("one", 1, 2))
        for p in rnd.sample(range(-3, most), n)
    ]
    df = spark.createDataFrame(data, "k string, pos long, v string, n long")
    w = Window.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag(F.struct("v")).over(w)
    want = df.withColumn("changed", (prev.isNotNull() & ~prev.eqNullSafe(F.struct("v"))).cast("long")).select(
        "k",
        "pos",
        F.coalesce(F.sum("n").over(before), F.lit(0)),
        F.coalesce(F.sum("n").over(upto), F.lit(0)),
        F.last("v", ignorenulls=True).over(upto),
        F.last("v", ignorenulls=True).over(before),
        F.sum("changed").over(upto),
    )
    values = {
        "earlier": ordered.Total(F.col("n")),
        "total": ordered.Total(F.col("n"), inclusive=True),
        "fill": ordered.Latest(F.col("v")),
        "last": ordered.Latest(F.col("v"), inclusive=False),
        "run": ordered.RunNumber(F.col("v")),
    }
    keyed = df.withColumn("k", F.coalesce("k", F.lit("none")))
    got = ordered.running(keyed, ["k"], "pos", values, block=block, levels=levels)
    assert got.columns == ["k", "pos", "v", "n", *values]
    assert rows(got.select(F.nullif("k", F.lit("none")), "pos", *values)) == rows(want)


def test_scans_of_running_values(spark, tmp_path):
    """Three totals read the rows twice, and their changes read no more."""
    spark.range(50).selectExpr("id % 3 AS k", "id AS pos", "id AS n").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    values = {c: ordered.Total(F.col("n")) for c in "abc"}
    assert scans(ordered.running(table, ["k"], "pos", values)) == 2
    values = {c: ordered.Total(F.col("n"), inclusive=True) for c in "abc"}
    deltas = semantic.snapshot_deltas(ordered.running(table, ["k"], "pos", values), ["k"], "pos", ["b"])
    assert scans(deltas) == 2


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().toString()
    return plan.partition("== Physical Plan ==")[2].partition("== Initial Plan ==")[0].count("Scan parquet")


def test_token_counts(spark):
    df = spark.createDataFrame([("b a b c b",), ("",)], "x string")
    got = multiset.with_token_counts(df, text.tokens(F.col("x")), "c").select("c").collect()
    assert [{t: n for t, n in r[0]} for r in got] == [{"a": 1, "b": 3, "c": 1}, {}]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 40, 101])
def test_summary_is_exact(spark, n):
    import math
    import statistics

    rnd = random.Random(n)
    values = [round(rnd.choice([0.0, 1.5, rnd.random() * 300]), 4) for _ in range(n)]
    df = spark.createDataFrame([("s", v) for v in values], "s string, v double")
    r = quantiles.summarise(df, ["s"], "v").first()
    assert (r["n"], r["maximum"]) == (n, max(values))
    assert r["median"] == pytest.approx(statistics.median(values))
    assert r["p95"] == sorted(values)[max(1, math.ceil(0.95 * n)) - 1]


def test_a_million_values_in_one_bin_are_never_sorted_together(spark):
    """Values a millionth apart share the first bin, and most of them the second."""
    series = spark.range(1_000_000).select(
        F.lit("s").alias("s"), (F.lit(1000.0) + F.col("id") / 1e6).alias("v")
    ).unionByName(spark.createDataFrame([("t", 0.0), ("t", 5e-324), ("t", 1e300)], "s string, v double"))
    distinct = quantiles.collapsed(series, ["s"], "v")
    ranks = spark.createDataFrame([("s", "a", 1), ("s", "b", 500_001), ("s", "c", 1_000_000), ("t", "a", 2)], "s string, name string, rank long")
    left = quantiles.candidates(distinct, ["s"], ranks, 1000)
    assert left.groupBy("s", "name").count().agg(F.max("count")).first()[0] <= 1000
    found = {(r["s"], r["name"]): r["value"] for r in quantiles.ranked_values(series, ["s"], "v", ranks, max_sorted=1000).collect()}
    assert found == {("s", "a"): 1000.0, ("s", "b"): 1000.5, ("s", "c"): 1000.0 + 999_999 / 1e6, ("t", "a"): 5e-324}


@pytest.mark.parametrize("max_sorted", [1, 2, 7])
def test_ranks_of_values_next_to_each_other(spark, max_sorted):
    """Neighbouring doubles around powers of two, where numbering them is delicate."""
    import random

    rng = random.Random(max_sorted)
    values = [0.0, 0.0]
    for base in (1.0, 2.0, 0.5, 1024.0, 3.0, 1e-310):
        x = base
        for _ in range(4):
            values.append(x)
            x = math.nextafter(x, 0)
        values += [math.nextafter(base, math.inf)] * rng.randrange(3)
    rng.shuffle(values)
    df = spark.createDataFrame([("s", v) for v in values], "s string, v double")
    ranks = [(n + 1, v) for n, v in enumerate(sorted(values))]
    wanted = spark.createDataFrame([("s", str(n), n) for n, _ in ranks], "s string, name string, rank long")
    found = quantiles.ranked_values(df, ["s"], "v", wanted, max_sorted=max(2, max_sorted))
    assert sorted((int(r["name"]), r["value"]) for r in found.collect()) == ranks


def test_summary_of_nothing_has_no_row(spark):
    assert quantiles.summarise(spark.createDataFrame([], "s string, v double"), ["s"], "v").count() == 0


def test_domain_counts_are_zero_filled(spark, rows):
    df = spark.createDataFrame([("a",), (None,), ("z",), ("a",)], "x string")
    got = counts.domain_counts(df, F.col("x"), ["a", "b"], other="unknown")
    assert rows(got) == [("a", 2), ("b", 0), ("unknown", 2)]
    assert rows(counts.domain_counts(df.limit(0), F.col("x"), ["a"])) == [("a", 0)]


def test_digests_match_python(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("é\"\n", "b/c")], "r string, g string")
    got = df.select(
        digest.sha256_fields(relevance=F.col("r"), groundedness=F.col("g")),
        digest.sha256_list(F.array("r", "g")),
        digest.resume_key(F.col("r"), F.col("g")),
    ).first()
    dump = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == sha(dump({"relevance": "é\"\n", "groundedness": "b/c"}))
    assert got[1] == sha(dump(["é\"\n", "b/c"])) and got[2] == dump(["é\"\n", "b/c"])


@pytest.mark.parametrize(
    "value, want",
    [
        ("429: tokens per day", "rate_limit_tpd"),
        ("TPM hit, 429", "rate_limit_tpm"),
        ("429 only", "other_failure"),
        ("Invalid context-score count", "malformed_output"),
        ("request timed out", "timeout"),
        ("connect error", "connection"),
        (None, "other_failure"),
    ],
)
def test_failure_cause(spark, value, want):
    assert one(spark, value, redact.failure_cause) == want


def test_redaction(spark):
    value = "gsk_a1 Bearer x.y org_q a.b@c.org /home/u/f, D:\\x\\y; n/home/z"
    got = one(spark, value, redact.log_explanation)
    assert got == (
        "<redacted> Bearer <redacted> <redacted-organization> <redacted-email> <redacted-path>, "
        "<redacted-path>; n/home/z"
    )
    got = one(spark, "bad\n at /srv/x token = t C:\\Users\\a\\b", lambda c: redact.error_message(c, "/srv/x"))
    assert got == "bad at <repository_root> token = <redacted> <redacted-path>"
