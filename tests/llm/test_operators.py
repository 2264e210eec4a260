"""Each operator against brute force or its library, on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vecloom.llm import bpe_codec, decontaminate, hmm_lm, line_dedup, media, ngram_join, pii, token_count, token_output, toxicity
from vecloom.llm.boosting import BoostedTrees
from vecloom.llm.common import released, scratch
from vecloom.llm.components import components

DDL = "doc_id long, text string, score double, token string, cell string, lines string, label string"
R = random.Random(4)
WORDS = ["".join(R.choice("abcdeéüñ") for _ in range(R.randrange(1, 9))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "one two three four"), (6, LONG), (7, LONG), (None, "a null id has this text of six words"), (8, "日本語 <|endoftext|> ՘ 🎉 a\x00b\x1c x\x85y"),
    (9, "Mail joe@x.example.com or 10.0.0.300 1.2.3.4, 4111 1111 1111 1111 +1 (555) 010-9999"), (10, "tie tie tie tie tie tie tie"), (10, "tie tie tie tie tie tie tie"), (11, "tie tie tie tie tie tie tie"), (12, "a" * 5000),
    *((100 + i, prose(R.randrange(1, 120))) for i in range(60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.0, "x", "x", "x", "x") for i, t in TEXTS], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_1_token_output(spark, docs, none):
    path = scratch(spark, "t")
    token_output.write_tokens(docs, path)
    got = token_output.token_digests(token_output.read_tokens(spark, path)).collect()
    lib = token_output.encoder(token_output.tokenizer_path("byte_bpe_50k.json")).lib
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_row(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    one = token_output.read_tokens(spark, path, [9]).collect()
    assert len(one) == 1 and one[0]["start"] == next(w[1] for w in want if w[0] == 9)
    empty = scratch(spark, "t")
    token_output.write_tokens(none, empty)
    assert token_output.read_tokens(spark, empty).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), least.get(find(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets))]


def test_2_ngram_join(docs, none):
    got = ngram_join.ngram_components(docs).collect()
    assert by_row(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(TEXTS), key=repr)
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (6, 7, 10, 11)) == [6, 10, 10]


@pytest.mark.parametrize("cells", [None, 8])
def test_2_one_large_near_group(spark, monkeypatch, cells):
    """Variants of one text: hot shingles, many cells and lots."""
    if cells:
        for name, value in (("CELL_MEMBERS", cells), ("GROUP_MEMBERS", 3), ("CELL_PAIRS", 50), ("LOCAL_SHINGLES", 5000)):
            monkeypatch.setattr(ngram_join, name, value)
    r, base = random.Random(9), [f"w{i}" for i in range(90)]
    rows = []
    for i in range(220):
        w = list(base[:r.choice([90, 90, 84])])
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_row(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=repr)


def test_2_sketch_holds_its_shingles_once(monkeypatch):
    """The sketch's counts, in the memory of its slots, one local count and the marks of that."""
    monkeypatch.setattr(ngram_join, "LOCAL_SHINGLES", 1_000_000)
    r = random.Random(11)
    texts = [b" ".join(b"%d" % r.randrange(60) if i % 3 else b"%d" % r.getrandbits(40) for _ in range(2000)) for i in range(1100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    tracemalloc.start()
    out = list(ngram_join._sketch_rows(2)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, local, n = Counter(), Counter(), 0
    for i, t in enumerate(texts):
        u = ngram_join.shingles(t, 2).tolist()
        local.update(u)
        n += len(u)
        if n >= ngram_join.LOCAL_SHINGLES or i == len(texts) - 1:
            for h, c in local.items():
                if c > 1:
                    want[h & (ngram_join.SKETCH - 1)] += c
            local, n = Counter(), 0
    assert {k: v for b in out for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())} == want
    assert max(b.num_rows for b in out) <= 1 << 16
    assert peak < 8 * ngram_join.SKETCH + 16 * ngram_join.LOCAL_SHINGLES


def test_2_whole_sets_leave_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "OUT_SHINGLES", 500)
    texts = [prose(200).encode() for _ in range(10)]
    sets = [ngram_join.shingles(t) for t in texts]
    rows = pa.RecordBatch.from_arrays([pa.array([ngram_join.set_hash(u) for u in sets]), pa.array(range(10)), pa.array([[i, i + 1] for i in range(10)]), pa.array(texts)], names=["h1", "node", "cells", "text"])
    out = list(ngram_join._whole_sets(5)([rows]))
    assert max(len(b.column(4).flatten()) for b in out) < 500 + 200
    got = [(r["cell"], r["node"], r["shingles"]) for b in out for r in b.to_pylist()]
    assert got == [(i + k, i, u.view(np.int64).tolist()) for i, u in enumerate(sets) for k in (0, 1)]


def test_workers_forget_other_operators(monkeypatch):
    """A worker's next task doesn't hold what another operator's tasks have kept."""
    bpe_codec.codec(bpe_codec.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    decontaminate._PRINTS["x"] = None
    assert list(released(lambda batches: iter([bpe_codec.codec.cache_info().currsize, len(decontaminate._PRINTS)]))([])) == [0, 0]


@pytest.mark.parametrize("cells", [None, 8])
def test_2_every_link(spark, monkeypatch, cells):
    if cells:
        for name, value in (("CELL_MEMBERS", cells), ("GROUP_MEMBERS", 3), ("CELL_PAIRS", 50)):
            monkeypatch.setattr(ngram_join, name, value)
    r, base = random.Random(6), [f"w{i}" for i in range(70)]
    rows = [(0, None), (1, " "), (2, "two words"), (3, "two words")]
    for i in range(4, 90):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(70)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    members, links = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string"))
    members, links = members.collect(), links.collect()
    of = {m["class_id"]: sets[m["doc_id"]] for m in members}
    assert {m["doc_id"]: of[m["class_id"]] for m in members} == sets and len(of) == len(set(sets.values()))
    want = {frozenset((a, b)) for a in set(sets.values()) for b in set(sets.values()) if a != b and a and b and 100 * len(a & b) >= 80 * len(a | b)}
    assert {frozenset((of[x["class_a"]], of[x["class_b"]])) for x in links} == want and len(links) == len(want)
    assert all(m["n_links"] == sum(sets[m["doc_id"]] in p for p in want) for m in members)


def test_2_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_3_media(spark, docs, none):
    folder = scratch(spark, "m")
    stored = media.store_media(docs, folder, shard_bytes=100_000)
    got = media.media_features(stored, folder).collect()
    want = []
    for i, t in TEXTS:
        p = media.padded((t or "").encode())
        png = media.to_png(p)
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.feature_of(p)))
    assert by_row(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == sorted(want, key=repr)
    heads = {r["doc_id"]: r for r in media.header_columns(stored, folder).collect()}
    assert heads[6]["width"] == 64 and heads[6]["height"] * 64 == len(media.padded(LONG.encode())) and heads[6]["bit_depth"] == 8
    empty = scratch(spark, "m")
    assert media.media_features(media.store_media(none, empty), empty).count() == 0


def test_3_png_opens_elsewhere(spark, docs):
    """The stored bytes as another decoder sees them: chunks, checksums, samples and header columns."""
    from urllib.parse import urlparse

    folder = scratch(spark, "m")
    kept = media.store_media(docs, folder)
    texts = {hashlib.sha256(p).hexdigest(): p for _, t in TEXTS for p in [(t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))]}
    for r in media.header_columns(kept, folder).collect():
        with open(f"{urlparse(folder).path}/shards/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            png = f.read(r["length"])
        at, data, head = 8, b"", None
        while at < len(png):
            n = int.from_bytes(png[at:at + 4], "big")
            kind, body, crc = png[at + 4:at + 8], png[at + 8:at + 8 + n], png[at + 8 + n:at + 12 + n]
            assert zlib.crc32(kind + body).to_bytes(4, "big") == crc
            head, data, at = body if kind == b"IHDR" else head, data + body * (kind == b"IDAT"), at + 12 + n
        width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
        raw = zlib.decompress(data)
        samples = b"".join(raw[i * (width + 1) + 1:(i + 1) * (width + 1)] for i in range(height))
        assert (png[:8], r["width"], r["height"], samples) == (b"\x89PNG\r\n\x1a\n", width, height, texts[r["digest"]])


def test_4_line_dedup(spark, none):
    a, b = "x" * 30 + " the first long line of it", "another quite long line, that is here only once"
    near = a.replace("first", "fxrst")
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"short\n{a}\nshort"), (3, near), (4, None), (5, ""), (6, a[:-1] + "\n" + a + "!"), (7, a.replace("first", "xxxxx")), (None, b), (8, a), (8, a), (9, f"{b}\n{b}é")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    want = [(1, rows[0][1]), (2, "short\nshort"), (3, ""), (4, None), (5, ""), (6, ""), (7, rows[6][1]), (None, ""), (8, ""), (8, ""), (9, "")]
    assert got == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=repr)
    assert line_dedup.dedup_lines(none).count() == 0


def test_4_wide(spark):
    """The pipeline's stage: three edits in a long line, exact copies of short lines of three words."""
    a = "the quick brown fox jumps over the lazy dog and then sleeps for a while"
    rows = [(1, f"{a}\nAll rights reserved.\n}}"), (2, f"{a.replace('fox', 'cat')}\nAll rights reserved.\n}}"), (3, f"{a.replace(' the', '', 1)}\nAll rights reserved!"), (4, a.replace("the ", ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "}", 3: f"{a.replace(' the', '', 1)}\nAll rights reserved!", 4: rows[3][1]}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_4_finds_every_near_line(spark, edits):
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r, lines = random.Random(edits), []
    for _ in range(25):
        s = "".join(r.choice("abé ") for _ in range(r.randrange(8, 14))).replace(" ", "z")
        for _ in range(4):
            t = list(s)
            for _ in range(r.randrange(edits + 2)):
                k = r.randrange(len(t))
                t[k:k + r.randrange(2)] = r.choice(["", "q", "é"])
            lines.append("".join(t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df, 5, edits).collect()}
    for i, t in enumerate(lines):
        gone = len(t) >= 5 and any(len(lines[j]) >= 5 and distance(lines[j], t) <= edits for j in range(i))
        assert got[i] == ("" if gone else t)


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("hot,levels", [(4, 3), (4, 1)])
def test_4_templated_lines(spark, monkeypatch, hot, levels):
    """Lines that share a half, families of near lines, and both: keys are made longer, nothing is lost."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LEVELS", levels)
    r = random.Random(hot + levels)
    head = "this line starts as many others do, and ends "
    lines = [head + "".join(r.choice("0123456789") for _ in range(24)) for _ in range(60)]
    for i in range(120):
        t = list(r.choice(lines[:40]) if i % 2 else head * 2)
        for _ in range(r.randrange(6)):
            k = r.randrange(len(t))
            t[k:k + r.randrange(2)] = r.choice(["", "q", "é", "zz"])
        lines.append("".join(t))
    r.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i:3 * i + 3])) for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(60):
        kept = [t for k, t in enumerate(lines[3 * i:3 * i + 3], 3 * i) if not any(abs(len(u) - len(t)) <= 3 and edit_distance(u, t) <= 3 for u in lines[:k])]
        assert got[i] == "\n".join(kept)


def test_4_many_templated_lines(spark, monkeypatch):
    """More lines of one template than a key's pairs are made for, of which some are near."""
    monkeypatch.setattr(line_dedup, "HOT", 200)
    r, head = random.Random(7), "a template that all of these lines share before digits "
    lines = [head + "".join(r.choice("0123456789") for _ in range(30)) for _ in range(3000)]
    lines += [t[:60] + ("x" if t[60] != "x" else "y") + t[61:] for t in lines[:500]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(8)
    kept = line_dedup.dedup_lines(df).where("text != ''").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(3000))


def test_4_copies_that_no_broadcast_names(spark, monkeypatch):
    """Copies that make keys themselves, as they are too many to be broadcast, change nothing."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    r = random.Random(11)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(30)]
    lines += [lines[i % 5] for i in range(40)] + [lines[20][:30] + "q" + lines[20][31:]] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(4)
    kept = line_dedup.dedup_lines(df).where("text != ''").select("doc_id").collect()
    assert sorted(x["doc_id"] for x in kept) == list(range(30))


def test_4_shuffles_keys_and_not_texts(spark):
    """Lines that share no segment are shuffled as keys only, and the shuffle files go with their executions."""
    r = random.Random(12)
    lines = ["".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) for _ in range(1200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(4).localCheckpoint()
    jvm = spark.sparkContext._jvm
    files = lambda: [f for f in map(str, jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks())) if "shuffle" in f]
    stages = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Double.TYPE, 0), None))
    before, old = {s.stageId() for s in stages()}, set(files())
    assert line_dedup.removed_lines(df).count() == 0
    assert sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in before) < 600_000
    left = set(files()) - old
    assert len({f.split("_")[1] for f in left}) <= 2, left  # those of the count above


def test_4_clashing_columns(spark):
    names = ["late", "id", "key", "line", "gone", "doc", "th", "pos", "h1", "_vl_doc", "_vl_gone"]
    df = spark.createDataFrame([(1, "a line of words " * 4, *names), (2, "a line of words " * 4, *names)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["a line of words " * 4, ""] and all(r[n] == n for r in got for n in names)


def test_5_token_count(docs, none):
    lib = token_count.library(token_count.tokenizer_path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in TEXTS]
    assert by_row(token_count.count_tokens(docs).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_count.count_tokens(none).count() == 0


ITEMS = [(1, prose(40)), (2, prose(15)), (3, "only three words"), (4, None), (5, ""), (6, "tie"), (None, prose(20)), (7, " ".join([WORDS[0]] * 30))]


def brute_hits(text, items):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_6_decontaminate(spark, docs, none, limit):
    rows = TEXTS + [(200, f"{prose(100)} {ITEMS[0][1]} {prose(3)}"), (201, ITEMS[1][1].upper()), (202, f"x {' '.join(ITEMS[0][1].split()[3:16])} y"), (203, "A: only, three; words!"), (204, " ".join([WORDS[0]] * 50)), (205, " ".join(ITEMS[0][1].split()[3:15]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(df, bench, limit).collect()
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted([(i, *brute_hits(t, ITEMS)) for i, t in rows], key=repr)
    assert decontaminate.contamination(none, bench, limit).count() == 0
    assert decontaminate.contamination(df, bench.limit(0), limit).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench, limit)
    assert kept.columns == docs.columns and kept.count() == sum(not brute_hits(t, ITEMS)[4] for _, t in TEXTS)


def test_6_repeated_words():
    """An item and a text that repeat a few words: the hits are whole, and their cost is not the square of the length."""
    r, names = random.Random(12), ["aa", "bb"]
    for size in (20, 60, 200):
        for _ in range(20):
            items = [(str(i), " ".join(r.choice(names[:1 + i]) for _ in range(size))) for i in range(2)]
            text = " ".join(["zz"] * 9 + [r.choice(names) if r.random() < 0.9 else "zz" for _ in range(2 * size)] + [items[1][1]])
            prints = decontaminate.Fingerprints([(n, t.encode()) for n, t in items])
            assert decontaminate.judge(text.encode(), prints) == brute_hits(text, items)
    word = ("word " * 20_000).encode()
    prints = decontaminate.Fingerprints([("1", word)])
    start = time.monotonic()
    assert decontaminate.judge(word, prints)[:3] == (20_000, 20_000, 1)
    assert time.monotonic() - start < 20


def levenshtein_within(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_7_automaton():
    terms = ["abcde", "bcdef", "abc", "abcdeabcde", "fedcbafed"]
    trie, r = toxicity.Trie(terms), random.Random(3)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k:k + r.randrange(2)] = r.choice(["", "a", "f"])
        w = "".join(w)
        near = [(levenshtein_within(w, t), n) for n, t in enumerate(terms) if levenshtein_within(w, t) <= toxicity.allowed(t)]
        assert trie.walk(w) == ((lambda e, n: (n, e))(*min(near)) if near else None), w


def test_7_toxicity(spark, docs, none):
    r = random.Random(2)
    rows = [(i, prose(20, r) + (r.choice([" you scoundrel ", " idiot ", " scoundrel idiot "]) if i % 4 == 0 else " ") + prose(20, r)) for i in range(600)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    assert {"scoundrel", "idiot"} <= set(model.terms)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(df, model).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(600)}
    tests = spark.createDataFrame([(1, "what an 1diot"), (2, "such a scoundrell here"), (3, 'he said "idiot" to us'), (4, None), (5, "")], "doc_id long, text string")
    s = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(tests, model).collect()}
    assert s[1] > 0.7 and s[2] > 0.5 and s[3] < 0.5 and s[4] == s[5] < 0.3
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(TEXTS)
    assert toxicity.score_toxicity(none, model).count() == 0


def test_8_base_patterns():
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = random.Random(8)
    for n in range(6000):
        t = "".join(r.choice("ab@@..-12 3+(" if n % 2 else "0123456789 .-+") for _ in range(70))
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want


@pytest.mark.parametrize("form", ["jane at example[dot]com", "jane at example [dot] com", "jane at example (dot) com", "jane at example.com", "jane[at]example.com"])
def test_8_gate_follows_the_pattern(form):
    text = f"please write to {form} today"
    assert pii.WRITTEN.search(text) and [k for k, _, _ in pii.candidates(text)].count(1) == 1


def test_8_trees_see_plain_prose():
    text = "We met at noon. Then they looked at the river. Nobody was at home."
    c = pii.candidates(text)
    trees, cuts = pii.detector()
    assert c and pii.choose([], c, trees.predict(np.array([pii.features(text, *x) for x in c], float)), cuts) == []
    text = "please write to jane at example[dot]com today"
    c = pii.candidates(text)
    assert [k for k, _, _ in pii.choose([], c, trees.predict(np.array([pii.features(text, *x) for x in c], float)), cuts)] == ["x_email"]


def test_8_pii(docs, none):
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert tuple(got[9][f"n_{k}"] for k in pii.BASE) == (1, 1, 1, 1)
    assert got[1]["spans"] == got[2]["spans"] == "" and pii.find_personal_data(none).count() == 0
    assert all(r["n_spans"] == len(r["spans"].split(",")) * bool(r["spans"]) for r in got.values()) and got[9]["n_spans"] >= 4
    trees, cuts = pii.detector()
    text = "my ssn 123-45-6789 and figure 1999-2004, phone (212) 555-0188."
    c = pii.candidates(text)
    added = pii.choose([], c, trees.predict(np.array([pii.features(text, *x) for x in c], float)), cuts)
    assert [text[s:e] for _, s, e in added] == ["123-45-6789", "(212) 555-0188"]


def test_8_choose_is_greedy_without_overlaps():
    r = random.Random(5)
    for _ in range(300):
        spans = lambda n: [(s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(n))]
        base, proposed = [("email", *s) for s in spans(3)], [(r.randrange(3), *s) for s in spans(15)]
        scores = np.array([r.randrange(10) / 10 for _ in proposed])
        taken, want = [s for _, *s in base], []
        for i in sorted(range(15), key=lambda i: (-scores[i], proposed[i])):
            k, s, e = proposed[i]
            if scores[i] >= 0.3 and all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                want.append((pii.ADDED[k], s, e))
        got = pii.choose(base, proposed, scores, (0.3, 0.3, 0.3))
        assert got[:3] == base and sorted(got[3:]) == sorted(want)


def test_8_boosting():
    r = np.random.default_rng(0)
    x = r.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((BoostedTrees().fit(x[:600], y[:600]).predict(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def test_9_hmm(docs, none):
    got = sorted(hmm_lm.score_documents(docs, passes=2).collect(), key=lambda r: (r["n_tokens"], repr(r["doc_id"])))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*(t or "").encode().lower().split(), None]) for i, t in TEXTS]
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, t) for i, t in toks), key=lambda x: (len(x[1]), repr(x[0])))
    for r, (i, t) in zip(got, want):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert hmm_lm.score_documents(none).count() == 0


def test_9_forward_is_exact():
    """Against the sum over all state paths; and a training pass never lowers the likelihood."""
    from itertools import product

    r = np.random.default_rng(1)
    m = hmm_lm.Model.initial(3, r.random(5), 2)
    seqs = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 2)]
    flat, n = np.concatenate(seqs), np.array([len(s) for s in seqs])
    for s, got in zip(seqs, m.log10(flat, n)):
        total = sum(m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[k, o] for k, o in zip(p, s)]) for p in product(range(3), repeat=len(s)))
        assert got == pytest.approx(np.log10(total))
    long = r.integers(0, 5, 400).astype(np.uint16)
    for _ in range(4):
        before = m.log10(long, np.array([400]))[0]
        m = m.next(*m.expected(long, np.array([400])), smooth=0)
        assert m.log10(long, np.array([400]))[0] >= before - 1e-9


def brute_counts(m, s):
    """Expected counts of one sequence from unscaled forward and backward vectors."""
    a, b = [m.start * m.emit[:, s[0]]], [np.ones(len(m.start))]
    for o in s[1:]:
        a.append((a[-1] @ m.move) * m.emit[:, o])
    for o in s[:0:-1]:
        b.insert(0, m.move @ (m.emit[:, o] * b[0]))
    total = a[-1].sum()
    moves = sum(np.outer(a[t], m.emit[:, s[t + 1]] * b[t + 1]) * m.move for t in range(len(s) - 1)) / total if len(s) > 1 else 0
    emits = np.zeros_like(m.emit)
    for t, o in enumerate(s):
        emits[:, o] += a[t] * b[t] / total
    return a[0] * b[0] / total, moves, emits


@pytest.mark.parametrize("segment", [1, 2, 5, 7, 1000])
def test_9_counts_are_those_of_whole_sequences(segment):
    r = np.random.default_rng(5)
    m = hmm_lm.Model.initial(3, r.random(6), 2)
    seqs = [r.integers(0, 6, n).astype(np.uint32) for n in (1, 2, 5, 6, 7, 14, 31, 120)]
    got = m.expected(np.concatenate(seqs), np.array([len(s) for s in seqs]), segment)
    for g, w in zip(got, (sum(x) for x in zip(*(brute_counts(m, s) for s in seqs)))):
        assert np.allclose(g, w)


def test_9_work_between_segments(monkeypatch):
    """Transfer matrices, the dearest part of long texts, are made only for segments that are neither first nor last."""
    made, transfer = [], hmm_lm.Model.transfer
    monkeypatch.setattr(hmm_lm.Model, "transfer", lambda m, classes, first, *n: made.append(len(first)) or transfer(m, classes, first, *n))
    r = np.random.default_rng(8)
    n = np.array([3, 10, 20, 45])
    hmm_lm.Model.initial(3, r.random(6), 2).expected(r.integers(0, 6, n.sum()), n, 10)
    assert sum(made) == 3


def test_9_nearly_impossible_steps():
    """Vectors are scaled every few steps only; runs of the least likely moves and classes stay exact."""
    tiny, n, segment = 1e-11, 60, 16
    move = np.array([[1 - tiny, tiny], [tiny, 1 - tiny]])
    emit = np.array([[1 - tiny, tiny], [tiny, 1 - tiny]])
    m, s = hmm_lm.Model(np.array([1 - tiny, tiny]), move, emit), np.arange(n) % 2
    logs, a = 0.0, m.start
    for t, o in enumerate(s):
        a = (a @ move if t else a) * emit[:, o]
        logs, a = logs + np.log10(a.sum()), a / a.sum()
    assert m.log10(s, np.array([n]))[0] == pytest.approx(logs)
    for size in (segment, n):
        starts, moves, emits = m.expected(s, np.array([n]), size)
        assert np.isfinite(moves).all() and (starts.sum(), moves.sum(), emits.sum()) == pytest.approx((1, n - 1, n))
        assert emits.sum(0) == pytest.approx(np.bincount(s))


def test_9_words_are_those_of_bytes_split(monkeypatch):
    """Words, numbers, hashes and classes against plain Python, for odd bytes too; packed numbers come back and are small."""
    r = random.Random(4)
    texts = [b"", b"  ", b" a b ", b"\x1c\x1d a\x85b\xc2\xa0c\xe3\x80\x80d", b"A\x0bB\x0cC\rD\tE\nF", b"\xff\xfe X \xff", "É ß ab ABC abcd".encode(), b"\x00 \x00"]
    texts += [bytes(r.choice(b"aB \t\n\x1f\x20\xe9") for _ in range(r.randrange(30))) for _ in range(200)]
    words = hmm_lm._Words()
    words.add(pa.array(texts[:50], pa.binary()))
    words.add(pa.array(texts, pa.binary()).slice(50))
    lengths, numbers, hashes, classes = words.numbered()
    flat, first = [w for t in texts for w in t.lower().split()], {}
    assert lengths.tolist() == [len(t.split()) for t in texts]
    assert numbers.tolist() == [first.setdefault(w, len(first)) for w in flat]
    assert hashes.tolist() == hmm_lm.hashes_of(list(first)).tolist()
    assert classes.tolist() == [hmm_lm.class_of(w) for w in first]
    for limit in ("CHUNK_TOKENS", "CHUNK_BYTES"):  # a count is sent at once or in parts
        monkeypatch.setattr(hmm_lm, limit, 100)
        counts = defaultdict(int)
        for b in hmm_lm._count(pa.RecordBatch.from_arrays([pa.array(texts[lo:lo + 20], pa.binary())], names=["t"]) for lo in range(0, len(texts), 20)):
            for h, cls, c in zip(*(x.to_pylist() for x in b.columns)):
                counts[h, cls] += c
        assert counts == Counter({(int(hmm_lm.hashes_of([w])[0]), hmm_lm.class_of(w)): c for w, c in Counter(flat).items()}) + Counter({(hmm_lm.END_HASH, 0): len(texts)})
        monkeypatch.undo()
    empty = hmm_lm._Words()
    empty.add(pa.array([b"", b" "], pa.binary()))
    assert [x.tolist() for x in empty.numbered()] == [[0, 0], [], [], []]
    for kind in (np.uint16, np.uint32):
        for n in (0, 1, 1000):
            x = np.array([r.randrange(1000) for _ in range(n)], kind)
            packed = hmm_lm.pack(x)
            assert hmm_lm.unpack(packed).tolist() == x.tolist() and len(packed) < 2 * n + 30


def test_9_chunks_and_pools_do_not_matter(spark, monkeypatch):
    """The same scores where a chunk ends with every batch and every batch is scored alone."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 80)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    scores = lambda: {x["doc_id"]: x[1:] for x in hmm_lm.score_documents(docs, passes=1).collect()}
    want = scores()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    for name, value in (("CHUNK_TOKENS", 100), ("POOL_TOKENS", 50)):
        monkeypatch.setattr(hmm_lm, name, value)
    try:
        got = scores()
    finally:
        spark.conf.set(key, before)
    assert got.keys() == want.keys()
    for i, x in got.items():
        assert x == pytest.approx(want[i])


def test_9_whole_query_equals_brute_force(spark):
    """Scores of the query against a plain recursion, sequence by sequence, with frequent words and a text of 1,200 tokens."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the"] * 20 + ["of"] * 10 + WORDS[:30]) for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(60, " ".join(r.choice(WORDS) for _ in range(1200)))]
    got = {x["doc_id"]: x for x in hmm_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=3, passes=2).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = {i: [*t.encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, t in toks.items() if not held(i) for w in t)
    n = sum(c.values())
    frequent = sorted((int(hmm_lm.hashes_of([w])[0]), w) for w in c if w is not None and c[w] >= 4 * n**0.5)
    assert frequent
    number = {w: hmm_lm.CLASSES + k for k, (_, w) in enumerate(frequent)}
    cls = lambda w: 0 if w is None else number.get(w) or hmm_lm.class_of(w)
    members = defaultdict(list)
    for w in c:
        members[cls(w)].append(w)
    shares = np.zeros(hmm_lm.CLASSES + len(number))
    for k, ws in members.items():
        shares[k] = sum(c[w] for w in ws) / n
    m = hmm_lm.Model.initial(3, shares)
    for _ in range(2):
        m = m.next(*(sum(x) for x in zip(*(m.expected(np.array([cls(w) for w in t], np.uint32), np.array([len(t)])) for i, t in toks.items() if not held(i)))))
    for i, t in toks.items():
        a, total = None, 0.0
        for w in t:
            k = cls(w)
            a = (m.start if a is None else a @ m.move) * m.emit[:, k]
            word = 1.0 if k == 0 or k >= hmm_lm.CLASSES else (c[w] + 1) / (sum(c[x] for x in members[k]) + len(members[k]) + 1)
            total, a = total + np.log10(a.sum() * word), a / a.sum()
        assert got[i]["score"] == pytest.approx(total, rel=1e-9)


def test_10_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t or "") for i, t in TEXTS]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := lib.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in rows]
    got = bpe_codec.encode_decode(docs).collect()
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert by_row(got, "doc_id", "ids", "decoded") == sorted(((i, lib.encode_ordinary(t), bytearray(t.encode())) for i, t in rows), key=repr)
    assert bpe_codec.encode_decode(none).count() == 0
    codec, r = bpe_codec.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), random.Random(6)
    for _ in range(300):  # characters of all blocks
        t = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x600), r.randrange(0x600, 0xD000), r.randrange(0x10000, 0x1FB00)])) for _ in range(60))
        assert codec.encode(t) == lib.encode_ordinary(t)
    for _ in range(400):  # long pieces exercise the joins
        raw = bytes(r.choice(b"aeinrst\xc3\xa9\xe4 0") for _ in range(r.randrange(1, 200)))
        ids = codec.encode_bytes(raw)
        assert ids == codec.merge(raw) and codec.decode(ids) == raw
