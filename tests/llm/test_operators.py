"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, decontaminate, fingerprints, language, near_dup, quotations, resharding, sentence_spans, url_templates, warc
from rowloom.llm.components import components
from rowloom.llm.words import windows
from rowloom.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, key string, DIGEST string, shard string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed")
ROWS = [
    (1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, NEAR, "en"), (4, prose(2, 90), None), (5, None, "en"), (6, "", "fr"),
    (7, "?!", None), (8, "short one", "fr"), (8, "short one", "fr"), (None, prose(3, 40), "fr"), (None, BASE, "en"), (9, prose(4, 30_000), "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "d", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    passage = " ".join(BASE.split()[20:60])
    return spark.createDataFrame([(1, passage.upper()), (1, passage), (2, "Short, one!"), (3, None), (None, "zz yy xx")], "item_id long, text string")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50 + i, 50) for i in range(1, 30)] + [(90, 90)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{50 + i: 50 for i in range(30)}}


def test_language(docs, none):
    profiles = language.fit(docs)
    assert set(profiles) == {"en", "fr"}
    got = language.identify(docs.select("doc_id", "text"), profiles).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (5, 6, 7)) and 0 <= r.score <= 1
    assert language.keep_known(docs, profiles).count() == len(ROWS) - 3
    assert language.fit(none) == {} and language.keep_known(none, {}).count() == 0
    assert language.keep_known(docs, {}).count() == len(ROWS) - 3


def test_language_learns_from_every_row(spark):
    rows = [("aaa", "x")] * 5_500 + [(f"{chr(98 + i % 20)}{chr(98 + i // 20)}", "x") for i in range(400)] + [("12", "y")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    profiles = language.fit(df)
    own = {k for t in dict.fromkeys(t for t, lang in rows if lang == "x") for k in language.ngrams(t)[0].tolist()}
    assert set(profiles) == {"x"} and len(own) > language.PROFILE == len(profiles["x"])
    assert set(language.fit(df, profile=len(own))["x"].tolist()) == own
    digits = df.filter("lang = 'y'")
    assert language.keep_known(df, language.fit(digits)).count() == len(rows) - 1


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.near_duplicates(docs).collect()), key=repr)
    want = [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (8, 8), (9, 9), (None, 1), (None, None)]
    assert got == sorted(want, key=repr)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, 7, 8, 9, None], key=repr)
    assert near_dup.near_duplicates(none).count() == near_dup.keep_one(none).count() == 0
    assert near_dup.near_duplicates(docs, weighted=True).count() == len(ROWS)


def test_signatures_of_many_short_texts_take_little_memory():
    rng = np.random.default_rng(6)
    elements, begin = rng.integers(0, 2**63, 60_000).astype(np.uint64), np.arange(10_001) * 6  # ten words, six shingles
    few = near_dup.dart_signatures(elements[:600], np.ones(600), begin[:101], 100)
    tracemalloc.start()
    all_ = near_dup.dart_signatures(elements, np.ones(len(elements)), begin, 100)
    peak = tracemalloc.get_traced_memory()[1] - all_.nbytes
    tracemalloc.stop()
    assert (all_[:100] == few).all() and peak < 60 << 20


def test_weighted_signatures_agree_as_often_as_the_similarity_says(monkeypatch):
    monkeypatch.setattr(near_dup, "DARTS", 500)  # sets in pieces too
    elements = np.concatenate((np.arange(1, 41), np.arange(21, 61))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weights = np.concatenate((np.arange(1, 41) % 5 + 0.5, np.arange(21, 61) % 3 + 1.0))
    a, b = near_dup.dart_signatures(elements, weights, np.array([0, 40, 80]), 4000)
    x, y = dict(zip(range(1, 41), weights[:40])), dict(zip(range(21, 61), weights[40:]))
    least, most = (sum(f(x.get(i, 0), y.get(i, 0)) for i in range(1, 61)) for f in (min, max))
    assert abs((a == b).mean() - least / most) < 0.04


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        words = prose(100 + g, 60 + 10 * g).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in [x.replace(".", "") for x in texts]]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_url_templates(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/de/1?x", "https://x.net/a/1", "https://x.net/b", "ftp://q.org/fr/", "http://x.net", "http://h.com/ok/1", "http://h.com/ok/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_templates.judge(pages).collect()}
    assert [got[i].host for i in range(5)] == ["", "", "", "a.example.com", "x.net"]
    assert got[3].rule == "example.com/de/" and got[3].verdict == "block" and got[3].path == "/de/1"
    assert got[4].rule == "net/" and got[6].rule == "org/fr/" and got[6].verdict == "allow" and got[7].rule is None
    assert got[7].verdict == "block", "its host has blocked labels only"
    many = [(i, f"http://h.com/{'bad' if i % 2 else 'good'}/{i}", i % 2 if i < 60 else None) for i in range(80)]
    learned = url_templates.judge(spark.createDataFrame(many, "page_id long, url string, label int"), rules=[], label="label").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in learned)
    assert {r.template for r in learned} == {"/bad/*", "/good/*"}
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_labels_of_one_kind_condemn_their_section_only(spark):
    urls = [("http://one.com/de/{}", 1)] * 12 + [("http://one.com/en/{}", None)] * 12 + [("http://other.org/fr/{}", 0)] * 15
    urls += [("http://few.com/de/{}", 1)] * 2 + [("http://few.com/en/{}", None)] * 2
    rows = [(i, u.format(i), label) for i, (u, label) in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r.page_id: r for r in url_templates.judge(pages, rules=[], label="label").collect()}
    assert len(got) == len(rows) and {got[i].verdict for i in range(12)} == {"block"} and {got[i].verdict for i in range(12, 39)} == {"allow"}
    assert got[0].template == "/de/*" and got[12].template == "/*/*"
    assert {got[i].template for i in range(39, 43)} == {"/*/*"}, "two labels are too few to tell a section apart"


def test_url_templates_next_to_their_sql(spark):
    import duckdb

    rng = random.Random(5)
    hosts = ["example.com", "a.example.com", "x.net", "b.example.net", "y.org", "Z.org", "q.io", ""]
    parts = ["de", "en", "fr", "a", "b", "", "*", "p1", "a" * 30]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))) for _ in range(1500)]
    urls += ["http://y.org/de/1"] * 300 + [None, "", "http://x.net", "no scheme/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": list(range(len(urls))), "url": pa.array(urls, pa.string())}))
    columns = ["page_id", "host", "path", "rule", "verdict", "template"]
    want = con.execute(f"SELECT {', '.join(columns)}, round(purity, 9) FROM ({url_templates.OP3_SQL})").fetchall()
    got = [(*r[:6], round(r[6], 9)) for r in url_templates.judge(pages).select(*columns, "purity").collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0])
    assert len({r[5] for r in got}) > 10


def test_url_templates_of_many_sections_and_deep_paths(spark):
    deep = "http://d.com/a/b/c/d/e/f/{}/x/y"
    urls = [(f"http://s.com/s{chr(97 + k // 26)}{chr(97 + k % 26)}/p", int(k % 4 == 0)) for k in range(80) for _ in range(20)]
    urls += [(deep.format("bad" if i % 2 else "good"), i % 2) for i in range(60)]
    urls += [("http://s.com/saa/q", None), ("http://s.com/sab/q", None), (deep.format("bad"), None), (deep.format("good"), None)]
    pages = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, label int")
    got = {r.page_id: r for r in url_templates.judge(pages, rules=[], label="label").collect()}
    assert all((got[i].verdict == "block") == (u[1] == 1) for i, u in enumerate(urls) if u[1] is not None)
    assert [got[len(urls) - n].verdict for n in (4, 3, 2, 1)] == ["block", "allow", "block", "allow"]
    assert got[len(urls) - 1].template == "/*/*/*/*/*/*/good/*/*"


def test_bpe(docs, none, spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    bits = ["it's", " don't  ", "  ", "\n\n", "a b", "<|endoftext|>", "'ll", "'", "123 45", "über ", "日本語", " !?", "\t "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 900))) for _ in range(40)] + [r[1] for r in ROWS] + [BASE * 40] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.digests(df, path).collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.shared_chunks(df) and bpe.shared_chunks(df, dictionary=0) == []
    # equal savings are one level, which may be larger than the dictionary
    twice = spark.createDataFrame([(i, prose(50 + i // 2, 4000)) for i in range(20)], "doc_id long, text string")
    assert 20 < len(bpe.shared_chunks(twice, dictionary=60)) < 120 < len(bpe.shared_chunks(twice))
    assert bpe.digests(none, path).count() == 0


SCRIPTS = {
    "english": ["the ", "house ", "don't ", "we'll, ", "end. ", "A1b2 "],
    "russian": ["\u0434\u043e\u043c ", "\u0443\u043b\u0438\u0446\u0430, ", "\u0441\u043b\u043e\u0432\u043e. ", "\u0438 "],
    "numbers": ["12.5;", "1,000\n", "7\t", "33 ", "-4;"],
    "ideographs": [*map(chr, range(0x5000, 0x9000, 90)), "\u5b57\u3002", "\u5927\u5b66\uff0c", "\u4e2d\u3001"] + ["\u3002"] * 20,
    "run": ["abcd", "xyz", "q"],
    "white": [" ", "\n", "\u3000", "\u00a0", "\r\n", "'", "s", "\u00e9", "e\u0301", "<|endoftext|>", "<|end", "\x1c", "9"],
}


def one_task(texts, path):
    """Ids of texts in one task, and the bytes that were encoded for them."""
    code, seen = bpe.codec(path), {}

    def part_of(part):
        if part not in seen:
            seen[part] = bpe.Encoded(code, np.array(code.encode(part.decode()), np.uint32))
        return seen[part]

    buffer, offset = bpe.text_bytes(pa.array(texts))
    data = buffer.tobytes()
    sure = bpe.boundaries_of(buffer, data, [t.encode() for t in code.special])
    out = []
    for places in bpe._chunks(buffer, offset):
        own = sure[(sure > places[0]) & (sure < places[-1])].tolist()
        out.append(bpe._repaired(data, places, [places[0], *own, places[-1]], part_of).tolist())
    return out, sum(map(len, seen))


@pytest.mark.parametrize("script", SCRIPTS)
def test_joins_of_chunks_at_any_cut(script, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(script)
    texts = ["".join(rng.choice(SCRIPTS[script]) for _ in range(rng.randrange(1, 700))) for _ in range(60)]
    mixed = [rng.choice(SCRIPTS[rng.choice(list(SCRIPTS))]) for _ in range(4000)]
    texts += ["".join(mixed[i : i + 200]) for i in range(0, 4000, 200)]
    for bits, shortest in ((9, 64), (4, 1)):  # the second: a cut every 16 bytes
        monkeypatch.setattr(bpe, "CUT_BITS", bits)
        monkeypatch.setattr(bpe, "SHORTEST", shortest)
        assert one_task(texts, bpe.default_path())[0] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("script", ["english", "russian", "numbers", "ideographs"])
def test_shared_passages_are_encoded_once(script):
    rng = random.Random(script)
    write = lambda n: "".join(rng.choice(SCRIPTS[script]) for _ in range(n))
    passage = write(8000)
    texts = [write(300) + passage + write(300) for _ in range(10)]
    assert one_task(texts, bpe.default_path())[1] < 0.4 * sum(len(t.encode()) for t in texts)


def test_ids_that_disagree_widen_the_window():
    code = bpe.codec(bpe.default_path())
    data = b"one two three four five six seven eight"
    bounds = [0, 3, 7, 13, 18, 23, 27, 33, len(data)]

    def part_of(part):  # a chunk by itself that is wrong next to its cut
        ids = code.encode(part.decode())
        return bpe.Encoded(code, np.array(ids if b"four five" in part or part in (data[:15], data[33:]) else code.encode("x" * len(part)), np.uint32))

    assert bpe._repaired(data, [0, 15, len(data)], bounds, part_of).tolist() == code.encode(data.decode())


def test_quotations(spark):
    rows = [
        (1, 0, "Shall we meet on Monday at noon? I will bring cake."),
        (1, 1, "On Mon, A wrote:\n> shall we meet on Monday\n> at noon? I will bring cake.\nYes please."),
        (1, 2, "> > Shall we meet on Monday at noon?\n> Yes please.\nGreat."), (1, 3, "New topic."), (1, 4, None),
        (None, 1, "> Yes please.\nhm"), (2, 0, "> nothing known"), (1, 3, "New topic."),
    ] + [(3, i, "The common line of all." if i % 2 == 0 else "> The common line of all.\nyes") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, text string, depth string, c string")
    got = quotations.without_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, i].parent_turn for i in range(5)] == [None, 0, 1, None, None]
    assert [by[1, i].root_turn for i in range(5)] == [0, 0, 0, 3, 4] and by[1, 2]["_depth"] == 2
    assert by[1, 1].text == "Yes please." and by[2, 0].text == "" and by[2, 0].parent_turn is None
    assert all(by[3, i].parent_turn == (i - 1 if i % 2 else None) for i in range(40))
    assert quotations.without_quotes(df.limit(0)).count() == 0


def test_archive(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\n", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 9), (6, "u", "é" * 9), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()), key=repr)
    want = [("1", 4, "revisit", "3"), ("2", 4, "revisit", "3"), ("3", 4, "response", None), ("4", 0, "revisit", "5"), ("5", 0, "response", None),
            ("6", 18, "response", None), ("6", 18, "response", None), (None, 5, "response", None)]
    assert got == sorted(want, key=repr)
    whole = warc.reconstruct(spark, path).collect()
    assert sorted(bytes(r.payload).decode() for r in whole) == sorted(h or "" for _, _, h in rows)
    assert all(bytes(r.record).endswith(b"\r\n\r\n") and bytes(r.record).startswith(b"WARC/1.1\r\n") for r in whole)
    warc.write_archive(pages.limit(0), f"{path}-none")
    assert warc.read_records(spark, f"{path}-none").count() == 0
    warc.write_archive(pages, f"{path}-large", least=10)
    assert {r.record_type for r in warc.read_records(spark, f"{path}-large").collect()} == {"response"}


def test_sentence_spans(docs, none):
    cut = sentence_spans.remove_repeats(docs, removed="cut").collect()
    by = {r.doc_id: r for r in cut if r.doc_id is not None}
    null = {r.text[:20]: r for r in cut if r.doc_id is None}
    assert len(cut) == len(ROWS)
    # rows without id come first, so theirs is the place that stays
    assert null[BASE[:20]].text == BASE and by[1].text == by[2].text == ""
    assert "changed" in by[3].text and len(by[3].text) < len(NEAR) / 3
    for r in ROWS:
        if r[0] in (4, 5, 6, 7, 8, 9):
            assert by[r[0]].text == r[1] and by[r[0]].cut == ""
    assert sentence_spans.remove_repeats(none).count() == 0


def test_long_passage_without_punctuation(spark):
    words = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, f"a b {words} c"), (2, f"x {words} y z")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(df).collect()}
    assert got[1] == f"a b {words} c" and len(got[2]) < len(words) / 2


def test_passages_of_51_words_at_any_word(spark):
    rng, rows, parts = random.Random(5), [], {}
    for n in range(0, 120, 2):
        own = [[f"{c}{n}x{i}" + ("." if i % 19 == 18 else "") for i in range(120)] for c in "pab"]
        passage = [w if n % 4 else w.strip(".") for w in own[0][:51]]
        for k in (0, 1):
            at = rng.randrange(20, 100)
            rows.append((n + k, " ".join(own[1 + k][:at] + passage + own[1 + k][at:])))
        parts[n + 1] = passage, own[2]
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[n] == text for n, text in rows if n % 2 == 0)
    for n, (passage, own) in parts.items():
        left = got[n].split()
        assert [w for w in left if w in own] == own, "words of the document itself stay"
        assert len(left) - len(own) <= 2 * (sentence_spans.NEXT - 1), n


def test_resharding(docs, none, spark):
    found = resharding.assign(docs, 3, 2)
    assert "_shard" in found.columns and found.count() == len(ROWS)
    for s, slots in found.groupBy("_shard").agg(F.sort_array(F.collect_list("slot"))).collect():
        assert slots == list(range(len(slots)))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    placed = resharding.assign(many, 8, 5)
    sizes = [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 2 * (97 + 16)
    moved = placed.filter("shard <> old_shard").agg(F.sum("size")).first()[0]
    assert moved < 1.05 * sum(sizes) * 3 / 8 + 500, "only what the three new shards need moves"
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    resharding.rewrite(placed, path)
    assert spark.read.parquet(path).count() == 3000
    assert resharding.assign(none, 3, 2).count() == 0


def brute_hits(text, items):
    words = WORD.findall((text or "").lower().encode())
    hit, named = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").lower().encode())
        n = min(13, len(w))
        known = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in known]
        hit |= {i + j for i in at for j in range(n)}
        if at and item is not None:
            named.add(str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(docs, none, items):
    want = sorted(((r[0], *brute_hits(r[1], [tuple(i) for i in items.collect()])) for r in ROWS), key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for limit in (1 << 20, 0):  # the second: too large to broadcast
        got = decontaminate.contamination(docs, items, broadcast_bytes=limit).select(columns).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
        kept = decontaminate.remove(docs, items, broadcast_bytes=limit)
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)
    cut = [sorted(decontaminate.remove(docs, items, what="spans", broadcast_bytes=limit).collect(), key=repr) for limit in (1 << 20, 0)]
    assert cut[0] == cut[1] and len(cut[0]) == len(ROWS)
    spans = {r.doc_id: r.text for r in cut[0]}
    assert spans[4] == ROWS[4][1] and 0 < len(spans[1]) < len(BASE) and spans[5] is None
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_windows_of_many_items_fit_their_estimate(spark):
    rows = [(i, prose(i, 400)) for i in range(200)] + [(f"copy{i}", prose(7, 400)) for i in range(100)] + [(None, prose(9, 30)), (1000, "a b"), (1001, None)]
    rows = [(None if i is None else str(i), t) for i, t in rows]
    known = decontaminate.WindowSet(rows, 13)
    built = len(known.words) + sum(a.nbytes for arrays in known.by_length.values() for a in arrays) + sum(len(n) for n in known.names)
    texts = spark.createDataFrame(rows, "item_id string, text string")
    assert decontaminate._small(texts, "item_id", "text", 2 * built) and not decontaminate._small(texts, "item_id", "text", built)
    found = decontaminate.scan(pa.array([prose(7, 400), "A b", prose(9, 30)]), known)
    assert found["n_items"] == [101, 1, 1 if any(i == "9" for i, _ in rows) else 0] and found["n_hit"] == [400, 2, 30]


def test_windows_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "windows", lambda w, n: (windows(w, n)[0] & decontaminate.U64(3 << 62), windows(w, n)[1]))
    rows = [(1, prose(1, 40)), (2, prose(2, 40)), (3, prose(1, 40)), (4, "c d")]
    found = decontaminate.scan(pa.array([prose(1, 40), prose(2, 30), prose(3, 40), "C, d"]), decontaminate.WindowSet(rows, 13))
    assert found["n_hit"] == [40, 30, 0, 2] and found["n_items"] == [2, 1, 0, 1]


def test_fingerprints(docs, none):
    got = fingerprints.compare_with_next(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ROWS)
    unique = {r.doc_id: r for r in got if r.doc_id in (3, 4, 5, 6, 7, 9)}
    for i, (key, text, _) in enumerate(order):
        if key in unique and key not in (7, 9):  # the next one of 7 and 9 is one of several rows
            n = len(text or "") // 4
            edited = (text or "")[: len(text or "") - n] + (order[i + 1][1] or "")[:n]
            assert unique[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.n_chars, set()).add(bytes(r.fingerprint))
    assert len(prints[len(BASE)]) <= 2 and unique[5].fingerprint == b""
    assert fingerprints.compare_with_next(none).count() == 0
    assert fingerprints.compare_with_next(docs.filter("doc_id = 4")).first().near_next == 1.0
