"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, __id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 120))) for _ in range(25)]
    texts = [None, "", " \n\t", "one two", base[0], base[0], base[1], base[2] + "\n" + base[3], base[3] + " " + base[4], "x " * 300, base[5].replace(" ", " ", 1)]
    texts += [" ".join(w if rnd.random() > 0.01 else "changed" for w in b.split()) for b in base for _ in range(2)]
    texts += [base[6] + "\n" + base[7][:-3] + "zzz", "same line here and there\n" * 3 + base[8], "＃ú" * 3000]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), -i, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(spark, docs, empty):
    from tidemark.llm.exact_dedup import drop_exact, exact_classes

    groups = Counter(r[1] or "" for r in corpus())
    got = by_id(exact_classes(docs, stays="max"))
    for i, t, *_ in corpus():
        same = [j for j, u, *_ in corpus() if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), groups[t or ""], i == max(same))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    # a hash that collides: equal lengths are not equal texts
    weak = by_id(exact_classes(docs, stays="max", hash_of=lambda c: F.length(c).cast("string").cast("binary")))
    assert all(weak[i].keep_id == got[i].keep_id for i in got)
    assert drop_exact(docs).count() == len(groups) and drop_exact(docs).columns == docs.columns
    assert exact_classes(empty).count() == 0


def test_source_mix(spark, docs, empty):
    from tidemark.llm.mixing import mix, repeat_by_mix

    one, two = (mix(docs).orderBy("doc_id").collect() for _ in range(2))
    assert one == two and len(one) == len(corpus())
    sizes = Counter()
    for i, t, _, s, *_ in corpus():
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    targets, open_sources = {}, dict(zip(names, [1, 2, 3, 1], strict=True))
    left = sum(sizes.values())
    while True:
        share = {s: left * w / sum(open_sources.values()) for s, w in open_sources.items()}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 3 * sizes[s]
            left -= targets[s]
            del open_sources[s]
    taken = Counter()
    for r in one:
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(r.size for r in one if r.source == s)
    assert repeat_by_mix(docs).count() == sum(r.copies for r in one)
    assert mix(empty).count() == 0


def test_rules(spark, docs, empty):
    from tidemark.llm.doc_rules import FEATURES, Trees, apply_rules, fit_trees

    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(apply_rules(docs, labels))
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        seen, twice = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), twice, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert apply_rules(empty, labels).count() == 0
    x = np.random.default_rng(1).random((500, 2))
    model = fit_trees(x, (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) < 0.5).astype(float), {0: -1})
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5)])
    assert isinstance(model, Trees) and (np.diff(model.score(line)) <= 1e-12).all() and len(FEATURES) == len(set(FEATURES))


def test_quality_votes(spark, docs, empty):
    from tidemark.llm.neighbour_quality import score_quality, vote

    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    got = by_id(score_quality(docs, labels, learn_from=F.col("doc_id") % 3 != 0))
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got.values())
    assert score_quality(empty, labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {1.0}
    known = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert vote(np.array([[1.0, 0.0], [0.0, 0.0]]), known, np.array([1.0, 0.0]), 1).tolist() == [1.0, 0.5]


def test_token_files(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.token_files import pack, read_token_files, unpack, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = by_id(read_token_files(spark, write_token_files(docs, path, 1)))
    for i, t, *_ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, zlib.crc32(got[i].ids)) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert read_token_files(spark, write_token_files(empty, path, 1)).count() == 0
    # another session finds all it needs in the folder
    folder = write_token_files(docs, path, 1)
    again = by_id(read_token_files(spark.newSession(), folder))
    assert {i: (r.start, bytes(r.ids)) for i, r in again.items()} == {i: (r.start, bytes(r.ids)) for i, r in got.items()}
    ranks, counts = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32), np.array([3, 0, 5])
    control, data, _, _ = pack(ranks, counts)
    assert unpack(control, data, counts).tolist() == ranks.tolist()


def test_line_dedup(spark, docs, empty):
    from tidemark.llm.line_minhash import dedup_lines

    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = by_id(got)
    lines = [(i, k, line.strip(" \t\n\r\x0b\f")) for i, t, *_ in corpus() for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    sets = [frozenset(x[2][j : j + 5] for j in range(max(1, len(x[2]) - 4))) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    lost = Counter(lines[a][0] for a in range(len(lines)) if find(a) != a)
    assert {i: r.n_removed for i, r in rows.items() if r.n_removed} == dict(lost)
    assert dedup_lines(empty).count() == 0


def test_ngram_join(spark, docs, empty):
    from tidemark.llm.ngram_join import keep_one, ngram_components

    got = by_id(ngram_components(docs))
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {i: (r.n_ngrams, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in sets}
    assert keep_one(docs).count() == sum(i == r for i, r in root.items())
    assert ngram_components(empty).count() == 0


def test_families_in_blocks(spark):
    from tidemark.llm.ngram_join import _family_links

    text = [f"w{i} " * 1 + " ".join(f"t{j}" for j in range(60)) for i in range(12)]
    rows = spark.createDataFrame(list(enumerate(text)), "id long, text string")
    members = rows.selectExpr("id", "57L as n", "id as comp", "0L as family")
    got = {(r.a, r.b) for r in _family_links(rows, members, 5, 80, block=3).collect()}
    assert got == {(a, b) for b in range(12) for a in range(b)}


def test_components(spark, monkeypatch):
    from tidemark.llm import components as C

    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    for size in (200_000, 5):
        monkeypatch.setattr(C, "PER_TASK", size)
        got = {r.node: r.root for r in C.components(edges).collect()}
        assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert C.components(edges.limit(0)).count() == 0


def test_subword_round_trip(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    from tidemark.llm.piece_prefix import codec, encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=path), codec(path), random.Random(2)
    for i, r in by_id(encode_decode(docs, path)).items():
        text = corpus()[i][1] or ""
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
    for _ in range(2000):
        text = "".join(rnd.choice(["the", " ", "  ", "\n", "é", "漢", "▁", "<s>", "\x00", "ing", "1", "😀"]) for _ in range(12))
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids and own.decode(ids) == library.decode(ids)
    assert own.decode([0, 200, 5]) == library.decode([0, 200, 5])
    assert encode_decode(empty, path).count() == 0


def test_byte_dedup(spark, docs, empty):
    from tidemark.llm.suffix_ranges import dedup_bytes

    first, got = {}, by_id(dedup_bytes(docs, buckets=7))
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in texts.items():
        out = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                out[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, o in zip(t, out, strict=True) if not o)
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(t), sum(out), kept)
        assert got[i].n_spans == len(re.findall(b"\1+", bytes(out)))
    assert dedup_bytes(empty).count() == 0


def test_window_dedup(spark, docs, empty):
    from tidemark.llm.fingerprint_index import dedup_windows

    seen, got = set(), by_id(dedup_windows(docs, batches=6, buckets=5))
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                out[k : k + 20] = [True] * 20
            seen.add(key)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(out), " ".join(x for x, o in zip(w, out, strict=True) if not o))
    assert dedup_windows(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        docs = docs.persist()
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]


def test_token_cache_equals_the_tokenizer_on_odd_words(monkeypatch):
    """Marks, special tokens, apostrophes, odd letters before punctuation, long words; the pool starts anew often."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm import textkit as K
    from tidemark.llm import token_files

    monkeypatch.setattr(token_files, "CACHED", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    cache, plain = token_files.UnitCache(path), Tokenizer.from_file(path)
    assert cache.apart
    alphabet = ["a", "B", "é", "É", "İ", "ß", "\u0301", "\u0338", " ", "\n", "\t", "\u00a0", "'", "'s", "'LL", ",", "!", "***", "<", ">", "|", "x" * 70]
    alphabet += ["<|endoftext|>", "<|ENDOFTEXT|>", "1", "²", "ª", "—", "한", "Σ", "Å", "÷", "×", "Ö", "ÿ", "_", "日", "\U0001f600", "\x00", "\r", "\x7f", "\x1c", "\u0085"]
    rng = random.Random(5)
    for _ in range(12):
        texts = [None, "", *("".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(1000))]
        ids, cuts = cache.encode(*K.utf8(pa.array(texts)))
        for x, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            assert ids[a:b].tolist() == plain.encode(x or "", add_special_tokens=False).ids


def test_pool_and_table_hold_what_they_were_given():
    from tidemark.llm.units import Pool, Table

    rng = np.random.default_rng(3)
    table, keys = Table(2), np.unique(rng.integers(1, 2**64, 5000, dtype=np.uint64))
    for part in np.array_split(keys, 7):
        table.add(part, (part % np.uint64(1000)).astype(np.int32))
    assert (table.find(keys) == (keys % np.uint64(1000)).astype(np.int32)).all() and (table.find(keys + np.uint64(1)) == -1).sum() >= 4990
    pool, made = Pool(50), []

    def make(at):
        made.append(len(at))
        return pool.keep(np.repeat(units[at], units[at].astype(np.int64) % 3).astype(np.uint32), units[at].astype(np.int64) % 3)

    for _ in range(20):
        units = rng.integers(1, 200, 60).astype(np.uint64)
        ids, cuts = pool.ids(units, np.array([4]), make, make)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [[u] * (u % 3) for u in units.tolist()]
    assert sum(made) > 200  # it started anew


def repeated_ids():
    """Rows that share an id: the same text twice, other texts, a copy of an earlier text; several null ids."""
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    a, b, c, d, e, f = (" ".join(words[60 * i : 60 * i + 60]) for i in range(6))
    late = " ".join(words[360:]) + " " + " ".join(words[:60])
    return [
        (3, b), (3, b), (4, c), (4, c), (5, d), (5, c), (5, d + " " + e), (6, f), (6, " ".join(words[360:380]) + " " + f),
        (7, b + " " + a), (None, a), (None, late), (None, a), (None, "short"), (None, None), (None, " ".join(words[380:]) + " tail"), (8, late),
    ]


def test_window_dedup_of_rows_that_share_an_id(spark):
    from tidemark.llm.fingerprint_index import dedup_windows

    rows = [(-(1 << 63) if i is None else i, WORD.findall(t or ""), i, t) for i, t in repeated_ids()]
    least, texts, want = {}, {}, []
    for key, w, _, t in rows:
        texts[t or ""] = min(texts.get(t or "", key), key)
        for k in range(len(w) - 19):
            place = (key, k)
            least[tuple(w[k : k + 20])] = min(least.get(tuple(w[k : k + 20]), place), place)
    for key, w, i, t in rows:
        out = [texts[t or ""] < key and len(w) >= 20] * len(w)
        for k in range(len(w) - 19):
            if least[tuple(w[k : k + 20])] < (key, k):
                out[k : k + 20] = [True] * 20
        want.append((i, len(w), sum(out), " ".join(x for x, o in zip(w, out, strict=True) if not o)))
    got = dedup_windows(spark.createDataFrame(repeated_ids(), "doc_id long, text string"), batches=3, buckets=5)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_byte_dedup_of_rows_that_share_an_id(spark):
    from tidemark.llm.suffix_ranges import dedup_bytes

    rows = [(-(1 << 63) if i is None else i, (t or "").encode(), i) for i, t in repeated_ids()]
    least, want = {}, []
    for key, t, _ in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], key), key)
    for key, t, i in rows:
        out = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < key:
                out[k : k + 50] = b"\1" * 50
        want.append((i, len(t), sum(out), len(re.findall(b"\1+", bytes(out))), bytes(b for b, o in zip(t, out, strict=True) if not o)))
    got = dedup_bytes(spark.createDataFrame(repeated_ids(), "doc_id long, text string"), buckets=7)
    assert Counter((*r[:4], bytes(r[4])) for r in got.collect()) == Counter(want)


def test_line_dedup_of_repetitive_lines(spark):
    from tidemark.llm.line_minhash import dedup_lines

    rnd = random.Random(3)
    phrase, other = "buy it now, ", "".join(rnd.choice("abcdefgh") for _ in range(150))
    lines = [x * (n // len(x) + 1) for x in ("=", "-+", phrase) for n in (60, 100, 200)]
    lines = [x[:n].strip() for x, n in zip(lines, (60, 100, 200) * 3, strict=True)] + [other[:120] + phrase * 9, other[:120] + phrase * 30, other]
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    got = by_id(dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert {i for i, r in got.items() if r.n_removed} == {i for i in range(len(lines)) if root.index(root[i]) != i}
    assert {1, 2, 4, 5, 7, 8, 10} <= {i for i, r in got.items() if r.n_removed}


def test_bands_find_similar_lines():
    """Recall of the banding at similarities of 0.80 to 0.86, by kind of signature."""
    from tidemark.llm import line_minhash as L

    rnd = random.Random(4)
    letters = "etaoin shrdlucmfwypvbgkqj  "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    grams = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    for n, kinds in ((40, {0}), (75, {0, 1}), (300, {1})):
        lines = []
        while len(lines) < 800:
            a = b = text(n)
            while True:
                c = list(b)
                c[rnd.randrange(len(c))] = rnd.choice(letters)
                c = "".join(c)
                if len(grams(a) & grams(c)) < 0.8 * len(grams(a) | grams(c)):
                    break
                b = c
            lines += [a, b]
        data = np.frombuffer("".join(lines).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        hashes, cuts = L.shingles(data, offsets[:-1], offsets[1:], wide=False)
        assert kinds <= set(L.signatures(hashes, cuts)[1].tolist())
        keys = [set() for _ in lines]
        for row, key in zip(*(x.tolist() for x in L.bands(hashes, cuts)), strict=True):
            keys[row].add(key)
        assert np.mean([bool(keys[i] & keys[i + 1]) for i in range(0, len(lines), 2)]) >= 0.99


def test_line_blocks_and_clashing_columns(spark, monkeypatch):
    """A family of lines that are compared in many blocks; columns named like the operator's own; shared ids."""
    from tidemark.llm import line_minhash as L

    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    base = [rnd.choice(words) for _ in range(30)]
    lines = [" ".join(w if rnd.random() > 0.09 else rnd.choice(words) for w in base) for _ in range(60)]
    sets = [{x[j : j + 5] for j in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    want = {i for i in range(len(lines)) if root.index(root[i]) == i}
    rows = [(i, x, "a", "b", "c", None) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, gone string, doc string, id long")
    for block in (2048, 8):
        monkeypatch.setattr(L, "BLOCK", block)
        kept = L.dedup_lines(docs, counts=False)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert {r.doc_id for r in got if r.text} == want and all((r.n_removed, r.gone, r.doc) == ("a", "b", "c") for r in got)
    assert sorted(L.dedup_lines(docs).columns) == sorted([*docs.columns, "n_lines"])
    shared = [(1, "A first\nB second"), (5, "A first\nC third"), (5, "D fourth\nB second"), (None, "E fifth"), (None, "E fifth"), (None, None), (7, "E fifth\nF sixth")]
    got = L.dedup_lines(spark.createDataFrame(shared, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.n_lines, r.n_removed) for r in got) == sorted(
        [(1, "A first\nB second", 2, 0), (5, "C third", 2, 1), (5, "D fourth", 2, 1), (-1, "E fifth", 1, 0), (-1, "E fifth", 1, 0), (-1, "", 1, 0), (7, "F sixth", 2, 1)]
    )


def test_byte_dedup_without_repeats(spark):
    from tidemark.llm.suffix_ranges import dedup_bytes

    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(300))
    for rows in ([(1, text()), (2, text()), (3, text())], [(1, text())], [(1, None), (2, None)]):
        got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(i, len(t or ""), 0, 0) for i, t in rows]


def test_ngram_join_of_rows_that_share_an_id(spark):
    """Several texts of an id are documents of their own; null ids count as the smallest and stay null."""
    from tidemark.llm.ngram_join import keep_one, ngram_components

    rnd = random.Random(7)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    near = lambda x: x + " tail"
    rows = [(3, a), (5, near(a)), (5, b), (7, near(b)), (7, near(b)), (None, c), (None, d), (9, near(c)), (4, near(d)), (None, None), (11, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_ngrams, r.component_id) for r in ngram_components(frame).collect())
    assert got == Counter([(3, 56, 3), (5, 57, 3), (5, 56, 5), (7, 57, 5), (7, 57, 5), (None, 56, None), (None, 56, None), (9, 57, None), (4, 57, None), (None, 0, None), (11, 0, 11)])
    kept = Counter((r.doc_id, r.text) for r in keep_one(frame).collect())
    assert kept == Counter([(3, a), (5, b), (None, c), (None, d), (None, None), (11, "")])


def test_quality_votes_equal_an_unblocked_version(spark, docs):
    """Every score from one product of all documents and all labelled vectors; repeated ids learn one text."""
    import pyarrow as pa

    from tidemark.llm import neighbour_quality as Q
    from tidemark.llm import textkit as K

    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(3, 0), (900, 1), (5, None)], "doc_id long, quality int")
    twice = docs.unionAll(docs.filter("doc_id = 7"))
    got = [(r.doc_id, r.score) for r in Q.score_quality(twice, labels, learn_from=F.col("doc_id") % 3 != 0).collect()]
    known = sorted({i: t or "" for i, t, *_ in corpus() if i < 40 and i % 3}.items())
    counts = Q.term_counts(*K.utf8(pa.array([t for _, t in known]))).astype(np.float16).astype(np.float32)
    projection, vectors = Q.fit_space(counts)
    values = np.array([float(i % 2) for i, _ in known])
    texts = [t or "" for _, t, *_ in corpus()]
    own = Q.term_counts(*K.utf8(pa.array(texts))) @ projection
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    want = {}
    for (i, *_), row in zip(corpus(), own @ vectors.T, strict=True):
        near = np.sort(row)[::-1][Q.NEIGHBOURS - 1]
        if (row >= near - 1e-6).sum() == Q.NEIGHBOURS:  # without a tie for the last place
            weight = np.where(row >= near, np.maximum(row, 0).astype(float) ** 16, 0)
            want[i] = (weight * values).sum() / weight.sum() if weight.sum() > 1e-12 else values.mean()
    assert len(got) == len(texts) + 1 and len(want) > 40
    for i, score in got:
        assert i not in want or score == pytest.approx(want[i], abs=1e-3)
    kept = Q.keep_good(docs, labels, 0.5, learn_from=F.col("doc_id") % 3 != 0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, score in got if score >= 0.5}


def test_pipeline_against_its_steps(spark, tmp_path):
    """run() over a small folder: lines, near-duplicates and ids by brute force and the library, on what each step before kept."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from tidemark.llm.mixing import mix
    from tidemark.llm.neighbour_quality import score_quality
    from tidemark.llm.queries import held_out

    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in corpus()]
    # the words of one document, but in lines like no other's
    words = rows[51][1].split(" ")
    rows.append((200, "\n".join(" ".join(words[k * len(words) // 3 : (k + 1) * len(words) // 3]) for k in range(3)), "en", "s1", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    scores = by_id(score_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), learn_from=~held_out()))
    kept = {r[0]: r for r in rows if scores[r[0]].score >= corpus_pipeline.LEAST_SCORE}

    def roots(sets, percent=80):
        root = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root = [root[b] if r == root[a] else r for r in root]
        return [root.index(r) == i for i, r in enumerate(root)]

    lines = [(i, k, x.strip(" \t\n\r\x0b\f")) for i, r in kept.items() for k, x in enumerate((r[1] or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    stays = roots([frozenset(x[2][j : j + 5] for j in range(max(1, len(x[2]) - 4))) for x in lines])
    gone = {(i, k) for (i, k, _), s in zip(lines, stays, strict=True) if not s}
    texts = {i: r[1] and "\n".join(x for k, x in enumerate(r[1].split("\n")) if (i, k) not in gone) for i, r in kept.items()}

    def grams(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    alone = roots([grams(texts[i]) for i in texts])
    left = spark.createDataFrame([(i, t, *kept[i][2:]) for (i, t), a in zip(texts.items(), alone, strict=True) if a], schema)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in mix(left).collect():
        ids = library.encode(texts[r.doc_id] or "")
        want[r.doc_id, tuple(ids), library.decode(ids)] += r.copies
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and 0 < len(kept) < len(rows) and gone and not all(alone)


def test_line_signatures_in_little_memory():
    """Hashes and bands of many lines: the values of a plain loop, and few bytes a character at once."""
    import tracemalloc

    from tidemark.llm import line_minhash as L
    from tidemark.llm import textkit as K

    rnd = random.Random(9)
    lines = ["".join(rnd.choice("abcdefgh ijklé") for _ in range(rnd.choice((3, 30, 70, 110, 300, 4000)))) for _ in range(60)]
    raw = [x.encode() for x in lines]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    hashes, cuts = L.shingles(data, ends - [len(x) for x in raw], ends, wide=False)
    assert np.diff(cuts).tolist() == [max(1, len(x) - 4) for x in lines]
    row, kind, values = L.signatures(hashes, cuts)
    for r, k, got in zip(row.tolist(), kind.tolist(), values, strict=True):
        own = [int(x) for x in hashes[cuts[r] : cuts[r + 1]]]
        if k:
            best = [min([x for x in own if (x >> 16) * L.SIZE >> 16 == i], default=None) for i in range(L.SIZE)]
            gaps = [next(g for g in range(L.SIZE) if best[i - g] is not None) for i in range(L.SIZE)]
            want = [(best[i - g] + g * 0x9E3779B9) % 2**32 for i, g in enumerate(gaps)]
        else:
            want = [min((x * int(a) + int(b)) % 2**32 for x in own) for a, b in zip(*L._TURNS, strict=True)]
        assert got.tolist() == want
    row, keys = L.bands(hashes, cuts)
    joined = (values.reshape(-1, L.BANDS, L.ROWS).astype(np.uint64) * L._JOIN).sum(axis=2, dtype=np.uint64)
    salt = K.mix((np.arange(L.BANDS) + kind[:, None] * L.BANDS).astype(np.uint64) + np.uint64(1))
    assert (keys == K.mix(joined + salt).reshape(-1)).all()
    data = np.frombuffer("".join(rnd.choice("abcdefgh ijkl") for _ in range(400_000)).encode(), np.uint8)
    starts = np.arange(0, len(data), 400)
    tracemalloc.start()
    hashes, cuts = L.shingles(data, starts, starts + 400, wide=False)
    assert tracemalloc.get_traced_memory()[1] < 14 * len(data)
    tracemalloc.stop()
    keys = np.sort(K.mix(np.arange(1000, dtype=np.uint64)))
    batch = L._ranged([keys, keys.view(np.int64), (keys % np.uint64(2)).astype(np.uint8)], 7)
    assert batch.column("bucket").to_pylist() == list(range(7))
    assert all((got == want).all() for got, want in zip(L._columns(batch.column("payload"), L.BAND), (keys, keys.view(np.int64), keys % np.uint64(2)), strict=True))
