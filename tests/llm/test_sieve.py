"""What is shuffled and written with its place: only what may be repeated."""

from pyspark.sql import functions as F

from rowloom.llm import sentence_spans
from rowloom.llm.common import sifted


def test_spans_that_occur_once_are_not_written(spark, monkeypatch):
    def text(n, words=12):
        return " ".join(f"w{n}x{i}." if i % 6 == 5 else f"w{n}x{i}" for i in range(words * 6))

    rows = [(n, text(n)) for n in range(300)] + [(300, text(7)), (301, text(7)), (302, None), (303, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, write = {}, sentence_spans.written

    def counted(df, label):
        out = write(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(sentence_spans, "written", counted)
    got = {r.k: sorted(r.places) for r in sentence_spans.repeats(docs).collect()}
    one = sorted({r.p for r in sentence_spans.spans(docs).filter("k = 7").collect()})
    assert got == {300: one, 301: one}
    # three texts hold repeats; the map of 2^27 bits lets hardly any other span through
    assert sizes["spans"] <= 3 * len(one) + 3 < sentence_spans.spans(docs).count()


def test_sieve_misses_nothing(spark):
    rows = spark.range(5000).select((F.col("id") * 7919).alias("h"), F.col("id").cast("string").alias("x"))
    wanted = rows.filter("h % 3 = 0").select(F.col("h").alias("a"))
    for bits in (64, 1 << 16, 1 << 27):
        got = sifted(rows, ["h"], wanted, ["a"], bits)
        assert got.columns == ["h", "x"]
        kept = [r.h for r in got.collect()]
        assert len(kept) == len(set(kept)) and {r.a for r in wanted.collect()} <= set(kept)
    assert sifted(rows, ["h"], wanted.limit(0), ["a"], 1 << 16).count() == 0
