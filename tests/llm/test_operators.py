"""The operators against plain versions and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, common, fingerprints, line_dedup, media, mixing, packing, quality, setsketch, textarrays, token_counts, url_filter, warc
from factorloom.llm.components import connected_components

from .helpers import ODD, clashing, docs, near_duplicates, repeated, words
from .helpers import line_dedup as plain_line_dedup


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def real(spark, sf, table="documents"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


# token counts and packing


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "s", "t", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "½", "!", "#", "日本", "<|endoftext|>", "'LL", "ve", "😀", "́", "\x1c", "\x85", "\u200b", "\u3000", "aaaa", "\r\n", "ﬁ", "\u0378", "�", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, "", " ", "a" * 5000]
    vocab, got = bpe.Vocabulary(token_counts.default_path()), []
    for _, _, counts, flat in vocab.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_classes_are_those_of_the_library(library):
    """Every assigned or unassigned character, between letters, digits and marks, and special strings at all edges."""
    vocab = bpe.Vocabulary(token_counts.default_path())
    points = [*range(0, 0x3000), *range(0xA000, 0xAC00), *range(0xD7A0, 0xD800), *range(0xE000, 0xE010), *range(0xF900, 0x11000), *range(0x11000, 0x1FC00, 5), 0x2FA1D, 0x31350, 0xE0001, 0x10FFFD]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    mark = "<|endoftext|>"
    texts += [mark, mark * 3, f"a {mark}", f"{mark} a", f" {mark} \n{mark}", f"x  {mark}  y", mark[:-1], f"{mark[1:]}{mark}", f"'{mark}s", "", f"é{mark}½"]
    got = [x.tolist() for _, _, counts, flat in vocab.encode(pa.array(texts)) for x in np.split(flat, np.cumsum(counts)[:-1])]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b] == []
    assert sum((c.tolist() for _, _, c, _ in vocab.encode(pa.array(texts), ids=False)), []) == list(map(len, want))


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i % 7}" for i in range(500)]
    want = [c.tolist() for _, _, c, _ in bpe.Vocabulary(token_counts.default_path()).encode(pa.array(texts))]
    monkeypatch.setattr(bpe, "KEPT", 10)
    monkeypatch.setattr(bpe, "chunks", lambda column: textarrays.chunks(column, 200))
    got = [c.tolist() for _, _, c, _ in bpe.Vocabulary(token_counts.default_path()).encode(pa.array(texts))]
    assert sum(got, []) == sum(want, [])


def test_token_counts(spark, sf, library):
    got = token_counts.count_tokens(real(spark, sf)).toPandas().set_index("doc_id")
    for r in real(spark, sf).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got.loc[r["doc_id"]]) == (len((r["text"] or "").encode()), n, n > 512)
    odd = token_counts.count_tokens(clashing(docs(spark))).collect()
    assert sorted(r["n_tokens"] for r in odd) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(1)
    lengths = np.array(sorted((rng.randint(1, 100) for _ in range(600)), reverse=True))
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            least = min(r for r, _ in fits)
            want.append(least)
            i = next(i for r, i in reversed(fits) if r == least)
            room[i] -= n
        else:
            want.append(100)
            room.append(100 - n)
    assert len(room) == bins.max() + 1 and want == (100 - offsets).tolist()


def test_repeated_rows_dont_make_one_group(spark):
    df = spark.createDataFrame([(1, "the same text")] * 2000, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(df, group_docs=200).select((F.col("sequence_id") / 2**32).cast("int").alias("g")).groupBy("g").count().toPandas()
    assert len(rows) == 10 and rows["count"].max() < 400


def test_pieces_stay_as_they_were_dealt(spark):
    """Packed pieces come from a written table, so that a lost task can't deal rows to other groups; an id may have any name."""
    pieces = spark.createDataFrame([(i % 50, 0, 0, 1 + i % 900, i) for i in range(2000)], "_group_ long, piece int, start long, length long, ids_crc32 long").repartition(7)
    packed = packing.pack(pieces, 5, 1000, "_group_")
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and packed.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = packed.collect()
    assert sorted(r["ids_crc32"] for r in rows) == list(range(2000))
    for own in {r["sequence_id"]: [x for x in rows if x["sequence_id"] == r["sequence_id"]] for r in rows[:50]}.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) <= 1000


def test_packing(spark, sf, library):
    df = real(spark, sf).select("doc_id", "text").union(docs(spark).select("doc_id", "text"))
    rows = packing.pack_documents(clashing(df), group_docs=100).toPandas()
    full = {}
    for r in df.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        full.setdefault(-99 if r["doc_id"] is None else r["doc_id"], []).append(ids)
    rows["doc_id"] = rows["doc_id"].fillna(-99).astype(int)
    for d, group in rows.groupby("doc_id"):
        want = []
        for ids in full[d]:
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
            want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(want) == sorted(zip(group["piece"], group["start"], group["length"], group["ids_crc32"], strict=True))
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) * 1.02 + 8
    assert packing.pack_documents(docs(spark, [])).count() == 0


# near-duplicates


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 200).astype(np.uint64)])
    off = np.array([0, 900, 1800, 1801, 1801])
    s = setsketch.sketches(np.concatenate([a, b, a[:1]]), off)
    union = setsketch.sketches(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]))[0]
    assert (setsketch.merge_sketches(s[0], s[1]) == union).all() and not s[3].any() and s[2].any()
    grid = np.linspace(0, 1, 101)
    like = [setsketch.log_likelihood((s[0] > s[1]).sum(), (s[0] < s[1]).sum(), (s[0] == s[1]).sum(), 900, 900, j) for j in grid]
    assert abs(grid[int(np.argmax(like))] - 700 / 1100) < 0.12


def test_bands_miss_hardly_any_pair_at_the_threshold():
    rng = np.random.default_rng(7)
    sets, off = [], [0]
    for _ in range(400):
        base = rng.integers(0, 2**63, 220).astype(np.uint64)
        for own in (base[:203], np.concatenate([base[17:203], base[203:]])):  # 186 of 220: 0.845
            sets.append(own)
            off.append(off[-1] + len(own))
    s, width = setsketch.sketches(np.concatenate(sets), np.array(off)), setsketch.band_width(0.85)
    n = setsketch.REGISTERS // width
    same = (s[::2, : n * width].reshape(400, n, width) == s[1::2, : n * width].reshape(400, n, width)).all(axis=2).any(axis=1)
    assert same.all()


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "hot"), [(3, 85, 1000), (3, 85, 5), (5, 80, 3)])
def test_near_duplicates_as_by_all_pairs(spark, n, percent, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(n)
    make = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    texts = [make(rng.randrange(1, 90)) for _ in range(40)]
    for edits, count in ((1, 25), (3, 25), (4, 20), (6, 20)):
        texts += copies(rng, make(100), count, edits)
    shared = make(60)
    texts += [f"{shared} {make(25)}" for _ in range(30)]
    chain = [make(120)]
    for _ in range(12):
        chain += copies(rng, chain[-1], 1, 2)
    texts += chain + texts[:10] + ["", None, "one", "one two", "ONE two"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, "odd one out"), (5, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = setsketch.near_duplicates(clashing(df), shingle=n, percent=percent)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert got == sorted(near_duplicates(rows, n, percent), key=str)


def test_near_duplicates_of_odd_rows(spark):
    got = setsketch.near_duplicates(clashing(docs(spark)), shingle=3, percent=85).collect()
    want = near_duplicates([(d, t) for d, t, *_ in ODD], 3, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    kept = setsketch.drop_near_duplicates(clashing(docs(spark)), shingle=3, percent=85)
    assert kept.columns == clashing(docs(spark)).columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in kept.collect()) == sorted((d or 0, (t or "")[:12]) for d, t in {(d, t) for d, t, *_ in ODD} - {(None, "a b c d e f"), (6, "ONE")})
    for f in (setsketch.near_duplicates, setsketch.drop_near_duplicates):
        assert f(docs(spark, [])).count() == 0


def test_clean_up_removes_tables_and_folder(spark):
    setsketch.near_duplicates(docs(spark, [(i, f"one two three four five {i % 3} six seven eight nine ten eleven", "en", "s", 1) for i in range(40)]), shingle=3, percent=60).count()
    mine = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("sets_")]
    assert mine() and __import__("os").path.isdir(common.run_dir(spark).removeprefix("file:"))
    common.clean_up(spark)
    assert not mine() and not __import__("os").path.isdir(common.run_dir(spark).removeprefix("file:"))


@pytest.mark.parametrize("hot", [1000, 2])
def test_components(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(20)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# line dedup


def line_hash(line):
    """The hash of a running line of words, as an exact sum."""
    data = np.frombuffer(b" ".join(line), np.uint8)
    h = line_dedup.word_hashes(data, np.array([0, len(data)]))[2]
    total = sum(int(x) * pow(int(line_dedup._BASE), j, 2**64) for j, x in enumerate(h)) % 2**64
    return int(textarrays.mix(np.array([total], np.uint64))[0])


def passages(rng, n=60):
    """Texts that share passages of 15 to 90 words, which begin and end anywhere in a line, and lines of other lengths."""
    pool = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([15, 25, 41, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 8)):
            w += rng.choice(pool) if rng.random() < 0.5 else [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))]
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "  ", "\n", "\t\n"]) for x in w)))
    return [*rows, (n, "again " * 500), (n + 1, "again " * 90), (n + 2, "a b " * 300), (n + 3, "end\n" * 19), (n + 4, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("least", "sure"), [(20, 40), (5, 5), (8, 12)])
def test_line_dedup_as_by_plain_winnowing(spark, seed, least, sure, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1000 if seed < 3 else 4)
    monkeypatch.setattr(line_dedup, "BLOCK", 64 if seed == 2 else line_dedup.BLOCK)
    rows = passages(random.Random(seed))
    texts, want = dict(rows), plain_line_dedup(rows, least, sure, line_hash)
    sound, found = repeated(rows, least), {}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in line_dedup.dedup_lines(df, least=least, sure=sure).collect():
        gone = found[r["doc_id"]] = want[r["doc_id"]]
        assert (r["n_deleted"], words(r["text"])) == (len(gone), [x for i, x in enumerate(words(texts[r["doc_id"]])) if i not in gone])
        assert gone <= sound[r["doc_id"]]
    # every run of ``sure`` words that came before has lost words, and less than a window at each of its ends is left
    seen = set()
    for d, text in rows[:-5]:
        w = words(text)
        lines = [tuple(w[i : i + sure]) for i in range(len(w) - sure + 1)]
        assert all(len(found[d] & set(range(i, i + sure))) >= least for i, x in enumerate(lines) if x in seen)
        seen |= set(lines)


def test_a_match_needs_both_hashes():
    """A match whose fingerprint agrees but whose second hash doesn't is not believed."""
    h = np.arange(100, 200, dtype=np.uint64)
    own = line_dedup.second_hash(h, np.arange(80), 20)
    assert len(set(own.tolist())) == 80 and line_dedup.second_hash(np.tile(h, 2), np.array([103]), 20) == own[3]
    match = pa.array([{"pos": 3, "own": -1, "second": int(own[3]) + extra, "before": bytes(4 * 21), "after": bytes(4 * 21)} for extra in (0, 1)])
    begin, end = line_dedup.runs_of(h, np.array([0, 100]), np.array([0, 0]), match, 20, 21)
    assert (begin.tolist(), end.tolist()) == ([3], [23])


def test_a_passage_goes_whole_wherever_it_begins_and_the_first_stays(spark):
    passage = [f"p{i}" for i in range(55)]
    first = f"Title\n\nsome words {' '.join(passage)} and more.\nlast line"
    rows = [(1, first), (2, f"own start {' '.join(passage[:30])}\n{' '.join(passage[30:])} own end\nlast"), (3, "\n".join(["head", *passage, "", "tail"])), (4, " ".join(passage)), (5, f"x\n{' '.join(passage[5:25])}\ny"), (6, f"x\n{' '.join(passage[5:24])}\ny"), (None, f"{' '.join(passage)} rest\n")]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (first, 0) and got[2] == ("own start\nown end\nlast", 55) and got[3] == ("head\n\ntail", 55) and got[4] == ("", 55) and got[None] == ("rest\n", 55)
    assert got[6] == (rows[5][1], 0) and got[5][1] in (0, 20)


def test_cut_keeps_what_is_left_apart():
    def cut(text, *gone):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, h, _ = line_dedup.word_hashes(data, np.array([0, len(data)]))
        return line_dedup.cut(text.encode(), s, e, np.isin(np.arange(len(h)), gone)).decode()

    assert cut("a b c", 1) == "a c" and cut("a b\nc d", 1, 2) == "a\nd" and cut("a\nb\nc", 1) == "a\nc" and cut("a\nb", 1) == "a" and cut("a\nb\n", 1) == "a\n"
    assert cut("  a b\nc", 0) == "  b\nc" and cut("a b \n\nc", 1) == "a \n\nc" and cut("a\n\nb\n\nc", 1) == "a\n\n\nc" and cut("a", 0) == "" and cut(" a \n", 0) == "" and cut("é b ü", 1) == "é ü"


def test_line_dedup_of_odd_rows(spark):
    passage = "\n".join(["some words in the first line of it"] * 2 + [f"and number {i} of its lines with more words" for i in range(5)])
    rows = [*ODD, (20, f"intro\n{passage}\noutro", "en", "s", 1), (21, f"{passage}\nown end", "en", "s", 1), (22, passage, "en", "s", 1), (22, passage, "en", "s", 1), (None, passage, "en", "s", 1)]
    df = clashing(docs(spark, rows)).withColumns({c: F.lit(7) for c in ("id", "hash", "pos", "fingerprint", "matches", "wanted", "first", "m", "e", "_0", "id_")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns and got.schema["n_deleted"].dataType.simpleString() == "bigint"
    texts = {(r["doc_id"], r["n_deleted"]): r["text"] for r in got.collect() if r["doc_id"] in (2, 3, 20, 21, 22) or r["n_deleted"]}
    n = len(words(passage))
    assert texts[20, 0].startswith("intro") and texts[21, n] == "own end" and texts[22, n] == "" and texts[None, n] == "" and texts[2, 0] is None and texts[3, 0] == ""
    assert got.count() == len(rows) and line_dedup.dedup_lines(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, least=9, sure=8)


# quality


def test_held_out_accuracy(spark, sf):
    d, labels = real(spark, sf.replace("sf0.001", "sf0.01")), real(spark, sf.replace("sf0.001", "sf0.01"), "labels")
    scored = quality.score(d, quality.train(d, labels), keep=["doc_id"]).withColumn("held_out", quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 50 and ((rows["predicted"] == rows["quality"]).mean()) > 0.97
    assert rows.loc[rows["quality"] == 1, "score"].mean() > 0.9 > 0.1 > rows.loc[rows["quality"] == 0, "score"].mean()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())
    odd = quality.score(clashing(docs(spark)), quality.train(d, labels))
    assert odd.count() == len(ODD) and odd.filter("score between 0 and 1").count() == len(ODD)
    assert odd.columns == [*(c for c in clashing(docs(spark)).columns if c not in ("score", "predicted")), "score", "predicted"]
    assert quality.drop_low_quality(clashing(d), labels).columns == clashing(d).columns
    assert quality.score(docs(spark, []), quality.train(d, labels)).count() == 0


def plain_statistics(text):
    """The statistics of one text, by plain loops over its words and lines."""
    raw, w = (text or "").encode(), words(text)
    if not w:
        return [0.0] * len(quality.FEATURES)
    size, n, lines = len(raw), len(w), [x for x in raw.split(b"\n") if x]
    share = lambda k, of: (k / of) ** 0.5
    kind = lambda chars: sum(c in chars for c in raw)
    upper, lower, symbols = bytes(range(65, 91)), bytes(range(97, 123)), b"!#$%&*|@<>{}[]=+~^_\\/`"
    head = w[: max(n // 10, 1)]
    pairs = list(zip(w, w[1:], strict=False))
    return [
        np.log1p(n), np.log1p(sum(map(len, w)) / n), share(kind(upper + lower), size), share(kind(upper), size), share(kind(b"0123456789"), size), share(kind(b".,;:'\"-()?"), size), share(sum(x.endswith(b".") for x in w), n), share(kind(symbols), size), share(sum(c > 127 for c in raw), size),
        np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(w)) / n * np.log1p(n), share(n - 1 - len(set(pairs)), n), share(sum(a == b for a, b in pairs), n), share(len(lines) - len(set(lines)), max(len(lines), 1)), share(sum(x[-1] in symbols for x in w), n),
        share(sum(len(x) > 1 and x[0] in upper and 64 <= x[1] < 96 for x in w), n), len(set(head)) / len(head),
    ]


def test_statistics_as_by_plain_loops(spark, sf):
    texts = [t for _, t, *_ in ODD if t is None or len(t) < 10_000] + [r["text"] for r in real(spark, sf).limit(60).collect()] + ["A AB ABC Ab a@ b_ c. d. d. d.\n\nA AB\nA AB\n"]
    got = np.concatenate([quality.statistics(d, o) for _, _, d, o in textarrays.chunks(pa.array(texts))])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_discriminant_is_the_difference_of_two_gaussian_densities():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 3)), rng.normal(1, 2, size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 1]])])
    y = np.repeat([0, 1], [80, 60])
    model = quality.fit(x, y, np.array([0.7, 0.3]), 0.3, 0.1)
    own = [np.cov(x[y == k], rowvar=False) for k in (0, 1)]
    pooled = 0.7 * own[0] + 0.3 * own[1]
    part = []
    for k, share in ((0, 0.7), (1, 0.3)):
        c = 0.7 * own[k] + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + np.diag(np.diag(pooled) * 1e-3 + 1e-9)
        d = x - x[y == k].mean(axis=0)
        part.append(np.log(share) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * (d @ np.linalg.inv(c) * d).sum(axis=1))
    assert np.allclose(model.log_odds(x), part[1] - part[0])
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.8


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(1, 60)], [(None, 0), (3, None)], [(1, 0), (2, 1)]])
def test_without_two_classes_every_score_is_a_half(spark, sf, labels):
    d = real(spark, sf)
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(d, model).select("score").distinct().collect()} == {0.5}


def test_fits_dont_depend_on_order_and_repeats(spark, sf):
    d, labels = real(spark, sf), real(spark, sf, "labels")
    a = quality.train(d, labels)
    b = quality.train(d.union(d).repartition(7), labels.union(labels).orderBy(F.desc("doc_id")))
    assert (a.means == b.means).all() and (a.inverse_factors == b.inverse_factors).all() and (a.slope, a.shift) == (b.slope, b.shift)
    few = quality.train(d, labels, most=30)
    assert few.means.shape == a.means.shape and not np.allclose(few.means, a.means)


def test_statistics_dont_depend_on_neighbours():
    texts = [t for _, t, *_ in ODD]
    whole = np.concatenate([quality.statistics(d, o) for _, _, d, o in textarrays.chunks(pa.array(texts))])
    one = np.concatenate([quality.statistics(d, o) for t in texts for _, _, d, o in textarrays.chunks(pa.array([t]))])
    assert np.allclose(whole, one) and np.isfinite(whole).all()


def test_contradicting_and_null_labels_are_left_out(spark, sf):
    d = real(spark, sf)
    labels = real(spark, sf, "labels").select("doc_id", "quality")
    noise = spark.createDataFrame([(None, 1), (1, None), (77777, 0), (77777, 1)], "doc_id long, quality int")
    a, b = quality.train(d, labels), quality.train(d, labels.union(noise))
    assert np.allclose(a.means, b.means)


# urls


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "org"), ("allow", "a.org/x"), ("block", "a.org/x/y"), ("allow", "dup.com/q"), ("block", "dup.com/q")]


def test_urls_as_by_all_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "b.net", "net", "a.org", "z.a.org", "org", "dup.com", "", "com:8080", "u@example.com"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/x", "/fr/", "/x", "/xy", "/x/y/z", "/q", "//en/", "/en/?a=/fr/", "?q=1/", "#/en/", "/x#frag"]
    urls = [rng.choice(["http://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(800)] + [None, "", "://", "a://b\n/c"]
    got = url_filter.judge_urls(clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), RULES).collect()
    for r in got:
        url = urls[r["page_id"]] or ""
        _, there, rest = url.partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = (rest[:cut].lower(), rest[cut:]) if there else ("", "")
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h.split(".")), len(s + p), v == "block", rule, v) for v, rule in RULES for h, s, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[3], best[4]), url
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_urls_of_any_depth(spark):
    deep, labels = "/".join(f"s{i}" for i in range(3000)), ".".join(f"l{i}" for i in range(1500))
    rules = [("block", f"x.com/{deep}/"), ("block", f"{labels}.com/"), ("allow", "x.com/s0/")]
    long = "http://x.com/" + "y/" * 200_000
    rows = [(1, f"http://x.com/{deep}/end"), (1, f"http://x.com/{deep}/end"), (2, f"http://a.{labels}.com/z"), (3, long), (4, f"http://x.com/{deep}")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("old"), "rule": F.lit("old")})
    got = url_filter.judge_urls(df, rules, keep=("page_id", "host", "rule"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    found = sorted((r["page_id"], r["verdict"], (r["rule"] or "")[:9]) for r in got.collect())
    assert found == [(1, "block", "x.com/s0/"), (1, "block", "x.com/s0/"), (2, "block", "l0.l1.l2."), (3, "allow", ""), (4, "allow", "x.com/s0/")]


# media


def test_media_round_trip(spark, sf, tmp_path):
    rows = [(d, t) for d, t, *_ in ODD] + [(r["doc_id"], r["text"]) for r in real(spark, sf).collect()]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media_columns(df).collect()), key=str)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=str)
    assert media.media_columns(docs(spark, [])).count() == 0


def test_stored_images_are_readable_by_any_reader(spark, sf):
    """Stored bytes and features against the public PNG format and plain sums."""
    import zlib as z

    for t in (b"", b"abc", bytes(range(256)) * 40, "é text\n".encode() * 999):
        samples = media.pad(t)
        image = media.to_png(samples)
        assert image.startswith(b"\x89PNG\r\n\x1a\n") and image[12:16] == b"IHDR" and image[-8:-4] == b"IEND"
        assert (int.from_bytes(image[16:20]), int.from_bytes(image[20:24]), *image[24:29]) == (64, len(samples) // 64, 8, 0, 0, 0, 0)
        at, body = 8, b""
        while at < len(image):
            n, kind = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
            assert z.crc32(image[at + 4 : at + 8 + n]) == int.from_bytes(image[at + 8 + n : at + 12 + n])
            body += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        lines = z.decompress(body)
        assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == samples and not any(lines[::65])
        a = [list(samples[i : i + 64]) for i in range(0, len(samples), 64)]
        flat = [x for r in a for x in r]
        p = [flat.count(v) / len(flat) for v in set(flat)]
        mean = sum(flat) / len(flat)
        edge = [int(len(a) * k / 8) for k in range(9)]
        bits = ""
        for s, e in zip(edge, edge[1:], strict=False):
            own = a[s : max(e, s + 1)]
            cells = [sum(sum(r[c * 7 : c * 7 + 7]) for r in own) for c in range(9)]
            bits += "".join("1" if y > x else "0" for x, y in zip(cells, cells[1:], strict=False))
        want = f"{mean:.4f}:{(sum((x - mean) ** 2 for x in flat) / len(flat)) ** 0.5:.4f}:{-sum(x * np.log2(x) for x in p):.4f}:{int(bits, 2):016x}"
        assert media.features(samples) == want
    found = media.media_columns(real(spark, sf)).collect()
    texts = {r["doc_id"]: r["text"] for r in real(spark, sf).collect()}
    for r in found:
        image = media.to_png(media.pad((texts[r["doc_id"]] or "").encode()))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.features(media.pad((texts[r["doc_id"]] or "").encode())))


def test_a_fault_in_the_directory_is_tried_again(spark, tmp_path, monkeypatch):
    import io

    path = str(tmp_path / "media")
    media.write_archives(docs(spark, [(i, f"text {i}", "en", "s", 1) for i in range(5)]).coalesce(1), path, "text", ("doc_id",)).collect()
    reader, opened, faults = media.ArchiveReader({"path": path, "retries": "3"}), media._seekable, [io.BytesIO(b"cut short"), OSError("away")]

    def shaky(p):
        if not faults:
            return opened(p)
        fault = faults.pop()
        if isinstance(fault, Exception):
            raise fault
        return fault

    parts = [p for p in reader.partitions() if p.archive]
    monkeypatch.setattr(media, "_seekable", shaky)
    assert sum(len(b) for p in parts for b in reader.read(p)) == 5 and not faults
    faults += [io.BytesIO(b"no archive") for _ in range(3)]
    with pytest.raises(media.zipfile.BadZipFile):
        list(reader.read(parts[0]))


def test_a_damaged_member_fails_for_good_and_alone(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    media.write_archives(docs(spark, [(i, f"text {i} " * 50, "en", "s", 1) for i in range(20)]).coalesce(1), path).collect()
    archive = next((tmp_path / "a").glob("*.zip"))
    import zipfile

    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[7]
    raw = bytearray(archive.read_bytes())
    raw[info.header_offset + 60] ^= 255
    archive.write_bytes(raw)
    monkeypatch.setattr(media.time, "sleep", lambda _: None)
    reader, opened, calls = media.ArchiveReader({"path": path, "batchBytes": "1", "retries": "3"}), media._seekable, []
    monkeypatch.setattr(media, "_seekable", lambda p: calls.append(p) or opened(p))
    rows = []
    with pytest.raises(OSError, match="damaged"):
        for batch in reader.read(reader.partitions()[0]):
            rows += batch.to_pylist()
    assert len(rows) == 7 and len(calls) == 2 + 3  # the directory and one stream, then three tries of the damaged member alone


def test_archives_are_read_by_byte_ranges_and_members_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    df = docs(spark, [(i, f"text {i} " * 50, "en", "s", 1) for i in range(300)])
    media.write_archives(df.repartition(3), path).collect()
    (tmp_path / "a" / ".half.zip").write_bytes(b"left by a lost task")
    reader = media.ArchiveReader({"path": path, "rangeBytes": "5000", "batchBytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 300 and len({r["keys"] for r in rows}) == 300
    opened, failed = media._seekable, []

    def shaky(p):
        if len(failed) < 7 and random.random() < 0.3:
            failed.append(p)
            raise OSError("store not reachable")
        return opened(p)

    first = parts[0]
    with opened(first.archive) as f, __import__("zipfile").ZipFile(f) as z:
        info = z.infolist()[0]
    monkeypatch.setattr(media, "_seekable", shaky)
    monkeypatch.setattr(media.time, "sleep", lambda _: None)
    reader.retries = 40
    assert all(reader._member(first.archive, info)[:4] == b"\x89PNG" for _ in range(20)) and failed
    assert media.read_archives(spark, path, rangeBytes="4000").count() == 300


# mixing


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 40), "en", rng.choice(["a", "a", "a", "b", "c", "é", None]), 1) for i in range(3000)] + ODD[:5]
    got = mixing.mix_plan(clashing(docs(spark, rows))).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    assert got["size"].sum() == sum(len(words(t)) for _, t, *_ in rows)
    total = {}
    for _, t, _, s, _ in rows:
        total[s] = total.get(s, 0) + len(words(t))
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, dict(weight), 1.5 * sum(total.values())
    while True:
        part = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in part if part[s] > 2 * total[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            del left[s]
    by = got.groupby(["source_size", "target"])["taken"].sum()
    assert sorted((k[0], round(k[1], 3)) for k in by.index) == sorted({(total[s], round(target[s], 3)) for s in total})
    assert all(abs(taken - k[1]) <= 25 for k, taken in by.items())
    again = mixing.mix_plan(docs(spark, rows).repartition(7)).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.values.tolist()))


def test_mixed_documents_are_those_of_the_plan(spark):
    df = clashing(docs(spark, [(i, "w " * (i % 9), "en", f"s{i % 4}", 1) for i in range(400)]))
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(df).collect()}
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plan.items() if v}
    for f in (mixing.mix_plan, mixing.mix_documents):
        assert f(docs(spark, [])).count() == 0
        assert f(docs(spark, [(1, None, None, None, None)])).count() <= 1


def test_repeated_rows_are_mixed_one_by_one(spark, monkeypatch):
    """A thousand rows without ids, alike or not, come as near to their target as others do."""
    for hot in (1000, 4):
        monkeypatch.setattr(common, "HOT", hot)
        for text in (lambda i: "w " * 10, lambda i: f"w{i} " + "w " * 9):
            rows = [(None, text(i), "en", "a", 1) for i in range(1000)] + [(i, "w " * 5, "en", "b", 1) for i in range(3000)] + [(7, text(i), "en", "c", 1) for i in range(300)]
            df = docs(spark, rows).repartition(3)
            got = mixing.mix_plan(df).withColumn("n", F.lit(1)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("n").alias("n")).collect()
            assert sum(r["n"] for r in got) == len(rows) and all(abs(r["taken"] - r["target"]) <= 10 for r in got)
            mixed = mixing.mix_documents(clashing(df)).groupBy("source").count().collect()
            size = {"a": 10, "b": 5, "c": 10}
            assert all(abs(r["count"] * size[r["source"]] - next(g["target"] for g in got if g["source_size"] == sum(len(words(x[1])) for x in rows if x[3] == r["source"]))) <= 10 for r in mixed)


# web archives


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "http://www.A.com/x/#f", "2024-01-01 00:00:00", 200, h(etag='"1"', content_length="9", server="s"), "d1"), (2, "https://a.com/x", "2024-01-03 00:00:00", 304, h(etag='W/"1"', content_length="0", date="now"), None),
        (3, "http://a.com/x", "2024-01-03 01:00:00", 304, h(etag='"2"'), None), (4, "http://a.com/y", "2024-01-03 00:00:00", 304, h(), None), (5, None, "2024-01-03 00:00:00", 304, None, None), (6, "http://a.com/x", None, 304, None, None),
        (7, "http://b.com:80", "2024-01-01 00:00:00", 200, None, "d7"), (8, "http://b.com/", "2024-01-01 00:00:01", 304, None, None), (9, "http://b.com/", "2024-01-01 00:00:00", 304, h(last_modified="t"), None), (None, "http://b.com/", "2023-01-01 00:00:00", 304, None, None), (8, "http://b.com/", "2024-01-01 00:00:01", 304, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured string, status int, headers map<string,string>, payload_digest string").withColumn("captured", F.to_timestamp("captured"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(clashing(df)).collect()}
    assert got[2]["resolved"] and got[2]["base_id"] == 1 and got[2]["payload_digest"] == "d1" and got[2]["status"] == 200
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-length": "9", "server": "s", "date": "now"}
    assert (got[3]["validation"], got[3]["resolved"], got[3]["status"]) == ("mismatch", False, 304)
    assert [got[k]["validation"] for k in (4, 5, 6, 8, 9, None, 1)] == ["none", "none", "none", "absent", "absent", "none", None]
    assert got[8]["payload_digest"] == "d7" and got[8]["resolved"] and not got[9]["resolved"]
    assert warc.resolve_revisits(df).count() == len(rows) and warc.resolve_revisits(df.limit(0)).count() == 0
    block = spark.createDataFrame([("A: 1\r\nb:2\r\nA: 3: x\r\njunk\r\n",), (None,), ("",)], "b string").select(warc.parse_headers(F.col("b"))).collect()
    assert block[0][0] == {"a": "3: x", "b": "2"} and block[1][0] is None and block[2][0] == {}


def test_revisit_records(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    same = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    rows = [
        (1, "http://a.com/x", "2024-01-01 00:00:00", 200, h(warc_payload_digest="sha1:A", content_type="t", warc_record_id="r1"), "d1"), (2, "http://b.com/copy", "2024-01-02 00:00:00", 200, h(warc_type="revisit", warc_profile=same, warc_payload_digest="sha1:A", warc_refers_to_target_uri="http://a.com/x"), None),
        (3, "http://a.com/x", "2024-01-03 00:00:00", 200, h(warc_type="revisit", warc_profile=same, warc_payload_digest="sha1:B"), None), (4, "http://b.com/copy", "2024-01-04 00:00:00", 304, h(), None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured string, status int, headers map<string,string>, payload_digest string").withColumn("captured", F.to_timestamp("captured"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert (got[2]["validation"], got[2]["base_id"], got[2]["payload_digest"], got[2]["resolved"]) == ("payload-digest", 1, "d1", True) and got[2]["headers"] == h(warc_payload_digest="sha1:A", content_type="t", warc_record_id="r1")
    assert (got[3]["validation"], got[3]["resolved"], got[3]["payload_digest"]) == ("mismatch", False, None)
    assert got[4]["validation"] == "none"  # the revisit of that url holds no response
    folded = spark.createDataFrame([("A: 1\r\n  2\r\n\t3\r\nB: 4",)], "b string").select(warc.parse_headers(F.col("b"))).first()[0]
    assert folded == {"a": "1 2 3", "b": "4"}


# fingerprints


def test_fingerprints(spark, sf):
    rows = [(d, t) for d, t, *_ in ODD] + [(r["doc_id"] + 100, r["text"]) for r in real(spark, sf).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_documents(clashing(df), bucket_docs=20).toPandas()
    assert len(got) == len(rows)
    known = sorted({(d, t) for d, t in rows if d is not None and d >= 100}, reverse=True)
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    for (d, t), (_, nxt) in zip(known, known[1:], strict=False):
        k = len(t) // 3
        assert by.loc[d, "edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest() and by.loc[d, "n_chars"] == len(t)
    prints = {}
    for _, r in got.iterrows():
        prints.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert got.loc[got["n_chars"] == 0, "fingerprint"].unique().tolist() == [":"]
    long = by[(by.index >= 100) & (by["n_chars"] > 100)]
    assert long["near_edited"].mean() > 0.4 > 0.05 > long["near_next"].median() and got["near_edited"].between(0, 1).all()
    assert fingerprints.fingerprint_documents(docs(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(docs(spark, [(1, "abc def ghi", None, None, None)])).first()
    assert one["near_next"] == 1.0


def plain_features(t, rank):
    """Selected windows of a text, by loops."""
    w, span = fingerprints.WINDOW, fingerprints.SPAN
    n = len(t) - w + 1
    if n < span:
        return [t[a : a + fingerprints.SHORT] for a in range(max(1, len(t) - fingerprints.SHORT + 1))] if t else []
    level = []
    for a in range(n):
        counts = np.bincount([fingerprints._CLASS[b] for b in t[a : a + w]])
        total = sum(round(c * np.log2(c) * 64) for c in counts if c)
        level.append(round((np.log2(w) - total / (64 * w)) * 16))
    key = [(int(rank[x]), a) for a, x in enumerate(level)]
    wins = [0] * n
    for a in range(n - span + 1):
        wins[min(key[a : a + span])[1]] += 1
    picked = [a for a in range(n) if wins[a] >= fingerprints.WINS] or [min(key)[1]]
    return [t[a : a + w] for a in picked]


def plain_digest(t, rank):
    """Filters as sets of bits, and how many features each holds."""
    distinct = list(dict.fromkeys(plain_features(t, rank)))
    out = []
    for k in range(0, len(distinct), fingerprints.FILL):
        bits = set()
        for f in distinct[k : k + fingerprints.FILL]:
            data = np.frombuffer(f, np.uint8)
            h = textarrays.hash_spans(data, np.array([0]), np.array([len(f)]), seed=31)
            more = int(textarrays.mix(h)[0])
            bits |= {((int(h[0]) >> (11 * i)) ^ more) % fingerprints.BITS for i in range(fingerprints.HASHES)}
        out.append((bits, len(distinct[k : k + fingerprints.FILL])))
    return out


def plain_likeness(a, b):
    if (len(a), sum(n for _, n in a)) > (len(b), sum(n for _, n in b)):
        a, b = b, a
    if not a or not b:
        return float(len(a) == len(b))
    score = 0
    for bits, n in a:
        best = 0
        for other, _ in b:
            chance = len(bits) * len(other) / fingerprints.BITS
            most = min(len(bits), len(other))
            low = chance + fingerprints.SLACK * (most - chance)
            best = max(best, min(1, max(0, (len(bits & other) - low) / max(most - low, 1e-9))))
        score += best * n
    return score / sum(n for _, n in a)


def test_digests_as_by_plain_loops():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdef ghij.\n0é") for _ in range(rng.choice([0, 1, 3, 7, 23, 38, 39, 60, 400, 3000]))).encode() for _ in range(40)] + [b"a" * 50, b"word " * 40]
    texts += [texts[-3][: len(texts[-3]) // 2] + b"another end of this text", bytes(range(256)) * 3]
    rank = fingerprints.rarity(np.array([rng.randrange(50) for _ in range(fingerprints.LEVELS)]))
    got, want = fingerprints.digests(texts, rank), [plain_digest(t, rank) for t in texts]
    for (filters, counts), own in zip(got, want, strict=True):
        assert counts.tolist() == [n for _, n in own]
        assert [set(np.flatnonzero(np.unpackbits(f.view(np.uint8))).tolist()) for f in filters] == [b for b, _ in own]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert fingerprints.likeness(got[i], got[j]) == pytest.approx(plain_likeness(want[i], want[j]), abs=1e-9)


def test_rarity_is_measured_over_all_windows(spark, sf):
    df = docs(spark, ODD).select("text").union(real(spark, sf).select("text").limit(40))
    seen = np.zeros(fingerprints.LEVELS, np.int64)
    for r in df.collect():
        t = (r["text"] or "").encode()
        if len(t) >= fingerprints.WINDOW:
            seen += np.bincount(fingerprints.entropy_levels(np.frombuffer(t, np.uint8)), minlength=fingerprints.LEVELS)
    rank = fingerprints.measure_rarity(df.repartition(3))
    assert (rank == fingerprints.rarity(seen)).all() and rank[int(np.argmax(seen))] == fingerprints.LEVELS - 1
    t = b"some text, 1234567 with SIGNS and ------------------------ a line"
    plain = [np.bincount([fingerprints._CLASS[b] for b in t[a : a + 24]]) for a in range(len(t) - 23)]
    assert fingerprints.entropy_levels(np.frombuffer(t, np.uint8)).tolist() == [round((np.log2(24) - sum(round(c * np.log2(c) * 64) for c in x if c) / (64 * 24)) * 16) for x in plain]


@pytest.mark.parametrize("kind", ["string", "int", "date", "double", "timestamp"])
def test_fingerprints_take_ids_of_any_kind(spark, kind):
    from datetime import date, datetime, timedelta

    make = {"string": lambda i: f"é{i}" if i % 3 else f"x{i}", "int": lambda i: i - 20, "date": lambda i: date(2024, 1, 1) + timedelta(i), "double": lambda i: i / 7, "timestamp": lambda i: datetime(1960, 1, 1) + timedelta(seconds=i)}[kind]
    rows = [(make(i), f"text number {i} " * (i % 5 + 1)) for i in range(60)] + [(None, "none a"), (None, "none b")] + [(make(3), f"{i} under the same id") for i in range(30)]
    df = spark.createDataFrame(rows, f"id {kind}, text string").repartition(4)
    got = [r["edited_sha256"] for r in fingerprints.fingerprint_documents(df, doc_id="id", bucket_docs=7).collect()]
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    comparable = lambda x: x.encode() if isinstance(x, str) else x
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: hashes[r[1]])
    known = sorted(known, key=lambda r: comparable(r[0]), reverse=True)
    line = known + sorted((r for r in rows if r[0] is None), key=lambda r: hashes[r[1]])
    want = sorted(hashlib.sha256(fingerprints.edit(a[1], b[1]).encode()).hexdigest() for a, b in zip(line, line[1:] + line[:1], strict=True))
    assert sorted(got) == want


def test_fingerprints_dont_depend_on_neighbours():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef ghij.\n") for _ in range(rng.choice([0, 3, 20, 38, 39, 60, 500, 4000]))).encode() for _ in range(120)]
    rank = fingerprints.rarity(np.arange(fingerprints.LEVELS)[::-1])
    whole = [fingerprints.to_text(d) for d in fingerprints.digests(texts, rank)]
    assert whole == [fingerprints.to_text(fingerprints.digests([t], rank)[0]) for t in texts]
    for d in fingerprints.digests(texts, rank):
        assert fingerprints.likeness(d, d) == 1.0
        back = fingerprints.from_text(fingerprints.to_text(d))
        assert (back[0] == d[0]).all() and (back[1] == d[1]).all()
