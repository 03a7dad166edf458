"""Operators without SQL, and the stages of the pipeline, next to plain versions of the same rules."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import bpe, fingerprints, quotations, resharding, sentence_spans
from rowloom.llm.common import text_hash
from rowloom.llm.queries import QUERIES
from rowloom.llm.words import shingles, windows, words_of
from tests.llm.test_operators import WORD, brute_hits, prose

SF = "/root/testdata/sf0.001"


def words_in(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def corpus(spark):
    """The documents, with near copies, repeated passages and benchmark passages between them."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 15]
    full = [d for d in docs if len((d[1] or "").split()) > 30]
    rng, more = random.Random(1), []
    for n in range(60):
        key, text, lang, source, _ = full[rng.randrange(len(full))]
        words = text.split()
        kind = n % 4
        if kind == 0:
            words[rng.randrange(len(words))] = f"new{n}"
        elif kind == 1:
            words = prose(700 + n, 50).split() + prose(600 + n // 20, 70).split() + prose(800 + n, 50).split()
        elif kind == 2:
            words = prose(900 + n, 40).split() + items[n % len(items)].split()
        text = " ".join(words)
        more.append((10**6 + n, text, lang, source, len(text)))
    odd = [(2 * 10**6, None, "en", "s", 0), (2 * 10**6 + 1, "", None, "s", 0), (2 * 10**6 + 2, "?!", None, None, 2), (2 * 10**6 + 3, "one", "en", None, 3), (2 * 10**6 + 4, "one", "en", None, 3)]
    return docs + more + odd


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame(corpus, schema).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


# --- op5 ------------------------------------------------------------------------------------


def brute_replies(messages):
    """For each (conversation, turn): latest earlier message that says the words of its outermost quote that has one."""
    said = defaultdict(set)
    for c, t, text in messages:
        own = quotations.split_quotes(text)[0]
        if c is not None and t is not None and own is not None:
            for i, piece in enumerate(quotations._pieces(own.split("\n"))):
                w = tuple(words_in(piece))
                if len(w) >= quotations.LEAST or i == 0 and w:
                    said[c, t].add(w)
    parent = {}
    for c, t, text in messages:
        found = []
        for level, lines in quotations.split_quotes(text)[1]:
            for i, piece in enumerate(quotations._pieces(lines)):
                w = tuple(words_in(piece))
                if len(w) >= quotations.LEAST or i == 0 and w:
                    found += [(-level, u) for (d, u), known in said.items() if d == c and c is not None and t is not None and u < t and w in known]
        if found:
            parent[c, t] = max(found + ([parent[c, t]] if (c, t) in parent else []))
    return {k: u for k, (_, u) in parent.items()}


def test_replies_in_quoted_conversations(spark):
    rng, rows = random.Random(4), []
    plain = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()]
    for c, t, text in sorted(plain, key=lambda r: (r[0], r[1])):
        before = [x for d, u, x in rows if d == c and u < t and x]
        quote = ""
        for _ in range(rng.randrange(0, 3) if before else 0):
            lines = rng.choice(before).split("\n")
            begin = rng.randrange(len(lines))
            quote += "".join(f"> {x}\n" for x in lines[begin : begin + rng.randrange(1, 4)]) + rng.choice(["", "On Monday they wrote:\n", "well\n"])
        rows.append((c, t, quote + (text or "")))
    # turns over several ranges, equal texts, and rows without conversation or turn
    for t in (5, 999, 1000, 2500, 2501, 7000):
        rows.append((900, t, "The same line that all of them say." if t < 2000 else "> the same line that all\n> of them say\nI agree with it."))
    rows += [(None, 3, "> well"), (900, None, "> The same line that all of them say."), (900, 2500, "> nothing known here at all"), (901, 1, None), (901, 2, "")]
    got = quotations.without_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    want = brute_replies(rows)
    assert sorted(map(repr, ((r.conv_id, r.turn, r.text, r.n_quotes) for r in got))) == sorted(
        repr((c, t, quotations.split_quotes(x)[0], len(quotations.split_quotes(x)[1]))) for c, t, x in rows)
    assert len(want) > 20
    for r in got:
        key, depth = (r.conv_id, r.turn), 0
        assert r.parent_turn == want.get(key)
        while key in want:
            key, depth = (key[0], want[key]), depth + 1
        assert (r.root_turn, r.depth) == (key[1], depth)


# --- op7 ------------------------------------------------------------------------------------


def brute_without_repeats(docs):
    """``{place: text}`` of rows (id, text), by dictionaries of whole runs of words."""
    seen, runs = defaultdict(set), {}
    for n, (key, text) in enumerate(docs):
        if text is None:
            continue
        w = words_of(pa.array([text]))
        said, data = words_in(text), text.encode()
        begins = [i for i in range(len(said)) if i == 0 or any(c in b".!?\n" for c in data[w.end[i - 1] : w.start[i]])]
        ends = [*begins[1:], len(said)]
        for a, b in list(zip(begins, ends)):
            if b - a > sentence_spans.LONG:
                begins += [i + 1 for i in range(a, b - 1) if int(w.hash[i]) % sentence_spans.CUT == 0]
        begins.sort()
        edges = [*begins, len(said)]
        found = []
        for i in range(len(begins) - sentence_spans.SPAN + 1):
            a, b = edges[i], edges[i + sentence_spans.SPAN]
            cuts = tuple(edges[i + j] - a for j in range(1, sentence_spans.SPAN))
            found.append((("sentences", cuts, tuple(said[a:b])), i, a, b))
        hashes = windows(w, sentence_spans.RUN)[0].tolist()
        chosen = set()
        for i in range(len(hashes) - sentence_spans.NEXT + 1):
            group = hashes[i : i + sentence_spans.NEXT]
            chosen.add(i + max(j for j, h in enumerate(group) if h == min(group)))
        found += [(("words", tuple(said[i : i + sentence_spans.RUN])), sentence_spans.WORD_PLACE + i, i, i + sentence_spans.RUN) for i in chosen]
        runs[n] = w, found
        for name, place, _, _ in found:
            seen[name].add((key, text, place))
    first = {name: min(places, key=lambda p: (p[0], p[2])) for name, places in seen.items()}
    out = {}
    for n, (key, text) in enumerate(docs):
        out[n] = text
        if n not in runs:
            continue
        w, found = runs[n]
        gone = {i for name, place, a, b in found if first[name] != (key, text, place) for i in range(a, b)}
        data, kept, last, count = (text or "").encode(), b"", 0, len(w.hash)
        for a in range(count):
            if a in gone and a - 1 not in gone:
                b = next(i for i in range(a, count + 1) if i not in gone)
                if b - a >= sentence_spans.MIN_WORDS:
                    kept += data[last : w.start[a] if a else 0]
                    last = w.start[b] if b < count else len(data)
        out[n] = (kept + data[last:]).decode()
    return out


def test_repeats_of_the_corpus(spark, corpus, folder):
    got = {r.doc_id: r.text for r in QUERIES["op7_sentence_spans"](spark, folder).collect()}
    want = brute_without_repeats([(d[0], d[1]) for d in corpus])
    assert sum(w != d[1] for w, d in zip(want.values(), corpus)) > 10
    assert got == {d[0]: want[n] for n, d in enumerate(corpus)}


# --- op8 ------------------------------------------------------------------------------------


def test_shards_of_the_corpus(spark, corpus, folder):
    got = {r.doc_id: r for r in QUERIES["op8_resharding"](spark, folder).collect()}
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_hash("text").alias("h"))
    hashes = {r.doc_id: r.h for r in df.collect()}
    size = {d[0]: len((d[1] or "").encode()) + 16 for d in corpus}
    old = {k: zlib.crc32(str(k).encode()) % resharding.OLD_SHARDS for k in size}
    supply = [sum(size[k] for k in size if old[k] == o) for o in range(resharding.OLD_SHARDS)]
    base, rest = divmod(sum(supply), resharding.SHARDS)
    room = [base + (j < rest) for j in range(resharding.SHARDS)]
    stay = [min(s, r) for s, r in zip(supply, room)]
    largest = max(size.values())
    for o in range(resharding.OLD_SHARDS):
        at = 0
        for k in sorted((k for k in size if old[k] == o), key=lambda k: (-math.floor(math.log2(size[k]) * 4), k, hashes[k])):
            # the documents whose middle lies in the bytes that stay are the first ones of their old shard
            assert (got[k].shard == o) == (at + size[k] // 2 < stay[o]), k
            at += size[k]
    by_shard = defaultdict(list)
    for key, text, *_ in corpus:
        r = got[key]
        assert (r.size, r.text_crc32, r.old_shard, r.law) == (size[key], zlib.crc32((text or "").encode()), old[key], "bytes")
        by_shard[r.shard].append(r)
    for j, rows in by_shard.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        # every shard has a cut with each old one that gives to it
        assert abs(sum(r.size for r in rows) - room[j]) <= largest * (1 + len({r.old_shard for r in rows}))
    # no plan moves fewer bytes than those beyond the room of their own shard
    moved = sum(r.size for r in got.values() if r.shard != r.old_shard)
    assert abs(moved - (sum(supply) - sum(stay))) <= largest * resharding.OLD_SHARDS


# --- op10 -----------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def scramble(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def brute_bins(text):
    """Low bits of the least hash in each bin, of one text; none without words."""
    elements = shingles(words_of(pa.array([text])), fingerprints.SHINGLE)[0].tolist()
    bins = [[] for _ in range(fingerprints.BINS)]
    for e in elements:
        h = scramble(e ^ int(fingerprints._SEED))
        bins[((h >> 32) * fingerprints.BINS) >> 32].append(h & 0xFFFFFFFF)
    if not elements:
        return None
    out = []
    for i in range(fingerprints.BINS):
        source, attempt = i, 0
        while not bins[source]:
            attempt += 1
            source = scramble(i * 0x9E3779B97F4A7C15 + attempt & MASK) % fingerprints.BINS
        out.append(scramble(min(bins[source])) & ((1 << fingerprints.BITS) - 1))
    return out


def brute_likeness(a, b):
    if a is None or b is None or a == b:
        return float(a == b)
    same, chance = sum(x == y for x, y in zip(a, b)) / len(a), 2.0**-fingerprints.BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def test_fingerprints_of_the_corpus(spark, corpus, folder):
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, folder).collect()}
    order = sorted((d[0], d[1] or "") for d in corpus)
    prints = [brute_bins(t) for _, t in order]
    packed = defaultdict(set)
    for n, (key, text) in enumerate(order):
        follow = (n + 1) % len(order)
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + order[follow][1][:quarter]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(brute_likeness(prints[n], brute_bins(edited)), abs=1e-9)
        assert r.near_next == pytest.approx(brute_likeness(prints[n], prints[follow]), abs=1e-9)
        packed[str(prints[n])].add(r.fingerprint)
    assert all(len(p) == 1 for p in packed.values()) and len({*map(str, packed.values())}) == len(packed)


# --- pipeline -------------------------------------------------------------------------------


def brute_classes(texts):
    """Least place reachable by links of similarity 0.8 or more, for each text."""
    sets = []
    for t in texts:
        w = words_in(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [root(i) for i in range(len(texts))]


def test_stages_of_the_pipeline(spark, corpus, folder):
    from tokenizers import Tokenizer

    held = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text").collect())

    known = stages["language"](spark, held, folder)
    scores = {r.doc_id: r.score for r in QUERIES["op1_language"](spark, folder).collect()}
    before = rows(known)
    assert before == sorted((d[0], d[1]) for d in corpus if scores[d[0]] > 0) and known.columns == held.columns
    assert len(before) >= len(corpus) - 10

    kept = stages["near_duplicates"](spark, known, folder)
    classes = brute_classes([t for _, t in before])
    single = rows(kept)
    assert single == [r for n, r in enumerate(before) if classes[n] == n] and kept.columns == held.columns
    assert len(single) < len(before) - 15

    cut = stages["repeats"](spark, kept, folder)
    want = brute_without_repeats(single)
    assert rows(cut) == [(key, want[n]) for n, (key, _) in enumerate(single)] and cut.columns == held.columns
    assert cut.filter(F.char_length("text") != F.col("n_chars")).count() == 0

    clean = stages["decontamination"](spark, cut, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    left = [r for r in rows(cut) if not brute_hits(r[1], items)[-1]]
    assert rows(clean) == left and clean.columns == held.columns and len(left) < cut.count()

    tokenizer = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [key for key, _ in left]
    for key, text in left:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[key].n_tokens == len(ids) and got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_stages_without_documents(spark, folder, stage):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, none, folder).count() == 0
