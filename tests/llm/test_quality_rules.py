import re
from collections import Counter

from pyspark.sql import functions as F

from playcohort.llm import quality_rules
from playcohort.llm.queries import op8_quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def test_whole_table_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_the_labels(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.5


def test_odd_rows(spark):
    texts = [
        None, "", " \n\t", "  é🙂 \x0b x", "a b c d e " * 3, "x\nx\n\nx\n y\ny", "a a a a a a a", "# * $ % & | < >",
        "w " * 20_000, "a b c d e f g a b c d e", "\n\n\nend", "lead\r\nlead\r\n",
    ]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(None, "x", "en", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_h", F.lit(1))
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute("x" if r.doc_id is None else texts[r.doc_id])
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_sketches_merge_and_bound(spark):
    values = spark.range(20_000).select((F.col("id") * 7).alias("v"))
    kept = values.select("v", quality_rules.bucket(F.col("v")).alias("b")).collect()
    assert all(r.b == r.v if r.v < 4096 else r.v * (1 - 2**-11) <= r.b <= r.v for r in kept)


PLAIN = "these are some words that make a line of quite usual length here"


def kept_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}


def test_each_ratio_can_reject(spark):
    """One document outside one fence only, none of them failing the base rules."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(10))
    rows = [(i, f"{PLAIN} {i}\n{own(i)}", "en", "big") for i in range(300)]
    rows += [
        (1000, " ".join(f"extraordinarily{k}" for k in range(20)), "en", "big"),
        (1001, " ".join(f"a{k % 10}" if k % 2 else f"{k}" for k in range(12)), "en", "big"),
        (1002, f"{PLAIN} 1 | < > # * % &", "en", "big"),
        (1003, f"{PLAIN}\nsame line\n{own(1)}\nsame line\n{own(2)}", "en", "big"),
        (1004, f"{PLAIN} {own(3)} {own(4)} {own(5)} {own(6)} {own(7)} one two of five words {own(8)} one two of five words", "en", "big"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].kept or got[i].base_failed for i in range(1000, 1005))
    assert got[1002].n_symbols and not got[1002].n_dup_lines
    assert got[1003].n_dup_lines and not got[1003].n_repeat_words and not got[1003].n_symbols
    assert got[1004].n_repeat_words and not got[1004].n_dup_lines


def test_small_groups_follow_their_language(spark):
    rows = [(i, f"{PLAIN} {i}", "en", "big") for i in range(300)] + [(1000, f"{PLAIN} | | | | | | | |", "en", "small")]
    kept = kept_of(spark, rows)
    assert not kept.pop(1000) and all(kept.values())


def test_a_group_comes_into_its_own_by_degrees(spark):
    """The fence of a source moves from its language's to its own as its documents grow in number."""
    fences = []
    for n in (1, 5, 10, 20, 40, 80, 160, 320):
        rows = [(i, f"{PLAIN} {i}", "en", "big") for i in range(300)]
        rows += [(1000 + i, f"{PLAIN} {'| ' * (1 + i % 8)}", "en", "code") for i in range(n)]
        docs = spark.createDataFrame(rows, "id long, text string, lang string, source string")
        counts = quality_rules.counted(docs, "text", ["lang", "source"])
        ratios = counts.select("*", *[quality_rules.thousandths(*p).alias(r) for r, p in quality_rules.RATIOS.items()])
        limits = quality_rules.thresholds(quality_rules.sketches(ratios, ["lang", "source"]), 100)
        fences.append({r.source: r.symbol_share_high for r in limits.collect()})
    code = [f["code"] for f in fences]
    assert code[0] == 0 and 0 < code[2] < code[3] and min(code[3:]) > 500
    assert fences[3]["big"] == 0 and fences[-1]["big"] < code[-1]


def test_sketches_stand_for_their_quantiles(spark):
    rows = [("r", b, n) for b, n in [(0, 700), (10, 200), (50, 99), (1000, 1)]]
    sketch = spark.createDataFrame(rows, "ratio string, bucket long, n long")
    got = {r.bucket: r.n for r in quality_rules.even_quantiles(sketch, [], 100).collect()}
    assert got == {0: 70, 10: 20, 50: 10}
    few = {r.bucket: r.n for r in quality_rules.even_quantiles(sketch.where("bucket = 50"), [], 7).collect()}
    assert few == {50: 7}


def test_plan_has_no_python(spark, sf):
    plan = op8_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
