"""Each operator against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldspan.llm import chat_format, decontaminate, jaccard_join, language_id, piece_lattice, queries, suffix_dedup, token_counts, token_files, topk_search, url_filter
from fieldspan.llm import _byte_bpe
from fieldspan.llm._byte_bpe import TOKENIZER, WordEncoder
from fieldspan.llm._common import components

LONG = "word and more of it " * 6000
ODD = [(None, None), (1, ""), (2, None), (3, "  \n"), (4, "ONE two"), (4, "ONE two"), (5, LONG), (6, "漢字 ① ﬁ x"), (7, "a b c d e f g h i j k"), (8, "a b c d e f g h i j k"), (9, "\x00 \t ."), (9, "other")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, repeated ids, and columns whose names operators use inside."""
    rows = [(d, t, None if d == 2 else "en", "s", 0, "x", 1, "y", 2, None) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 string, cls int, spans string, score int, word string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


# --- 1


def test_languages(spark, sf):
    out = language_id_rows = queries.queries()["op1_language_id"](spark, sf).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [r for r in language_id_rows if r.held_out]
    assert len(out) == len(lang) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_spans_of_mixed_text(spark, sf):
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~language_id.held_out())
    text = "The theou of the and thonre was is in the. Die der und achtzheit öchß von den zu einß die der."
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 !"), (4, "привет мир")], "doc_id long, text string")
    r = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert [s.lang for s in r[1].lang_spans] == ["en", "de"] and text[r[1].lang_spans[1].start : r[1].lang_spans[1].end].startswith("Die")
    assert (r[2].lang_pred, r[3].lang_pred, r[4].score) == ("und", "und", 0.0) and r[4].lang_pred in model.langs


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    count = np.array([3, 0, 7, 1, 5])
    scores = rng.normal(size=(16, 3)).astype(np.float32) * 3
    got, first = language_id.viterbi(scores, count, 2.0), np.cumsum(count) - count
    for a, n in zip(first, count):
        if n:
            best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:])))
            assert got[a : a + n].tolist() == list(best)


def test_languages_by_brute_force(spark):
    learn = [("en", "the cat and the other hat were over there"), ("de", "der hund und die andere katze waren dort"), ("ru", "кот и собака были там"), ("fr", "le chat et l'autre chien étaient là")]
    asked = ["the dog and the cat", "der Hund über the hat", "кот the и там", "THE ΑΒΓ 12", "là-bas le chien и собака der Hund und die Katze", "12 !", "", None, "漢字"]
    model = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(learn * 3)], "doc_id long, text string, lang string"), F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    langs = sorted({lang for lang, _ in learn})

    def script(c):
        return next((n for n, a, b in reversed(language_id.SCRIPTS) if a <= ord(c) <= b), "other")

    def words(t):
        return re.findall(r"[^\W\d_]+", t or "")

    def trigrams(w):
        x = ["", *w.lower(), ""]
        return list(zip(x, x[1:], x[2:]))

    count, seen = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for lang, t in learn * 3:
        for w in words(t):
            count[lang].update(trigrams(w))
            seen[lang][script(w[0])] += len(w)
    def label(t):
        known, scores = [], []
        for w in words(t):
            may = [k for k in langs if seen[k][script(w[0])] / sum(seen[k].values()) >= language_id.SCRIPT_SHARE]
            if may:
                known.append(w)
                scores.append([sum(np.log((count[k][g] + 0.5) / (sum(count[k].values()) + 0.5 * language_id.SLOTS)) for g in trigrams(w)) if k in may else -1e9 for k in langs])
            else:
                scores.append([0.0] * len(langs))
                known.append(None)
        best = max(itertools.product(range(len(langs)), repeat=len(scores)), key=lambda p: sum(s[i] for s, i in zip(scores, p)) - language_id.PENALTY * sum(a != b for a, b in zip(p, p[1:])), default=())
        share = Counter()
        for w, i in zip(known, best):
            if w:
                share[langs[i]] += len(w)
        letters = sum(map(len, words(t)))
        if not letters:
            return "und", 0.0
        return (max(langs, key=lambda k: share[k]), max(share.values()) / letters) if share else (None, 0.0)

    for i, t in enumerate(asked):
        if len(words(t)) <= 6:
            lang, score = label(t)
            assert got[i][1] == pytest.approx(score) and (lang is None or got[i][0] == lang), t
    assert got[0][0] == "en" and got[2][0] == "ru" and got[5][0] == got[6][0] == got[7][0] == "und"


def test_languages_are_learned_under_one_id(spark):
    rows = [(None, f"the {w} and the other {i}", "en") for i, w in enumerate("abcdefgh" * 5)] + [(None, f"der {w} und das andere {i}", "de") for i, w in enumerate("abcdefgh" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True), rows=20)
    assert model.langs == ["de", "en"] and {(r.lang, r.lang_pred) for r in language_id.identify(df, model).collect()} == {("de", "de"), ("en", "en")}


def test_languages_of_odd_tables(odd, empty):
    model = language_id.fit(odd, F.lit(True))
    assert len(language_id.identify(odd, model).collect()) == len(ODD)
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


# --- 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")


@pytest.mark.parametrize("shard", [7, 8192])
def test_search(spark, shard):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 9)).astype(np.float32).round(1)
    x[rng.random(x.shape) < 0.5] = 0
    x[30:60] = x[0]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(500, None, None), (501, [1.0, None], None), (502, [float("nan")] * 9, None), (503, [float("inf")], None), (None, [1.0], None), (505, [1.0], None), (506, [], None)]
    q = topk_search.quantized(vectors(spark, rows), "vec_id", "embedding")
    got = sorted(map(tuple, topk_search.search(q.where("id % 20 = 0"), q, 20, shard).collect()))
    full = {i: np.pad(np.floor(64 * np.array(v, float)), (0, 9 - len(v))).astype(int) for i, v, _ in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)}
    want = [(a, k + 1, b, s) for a in full if a % 20 == 0 for k, (s, b) in enumerate(sorted(((int(full[a] @ full[b]), b) for b in full if b != a), key=lambda p: (-p[0], p[1]))[:20])]
    assert got == sorted(want)


def test_search_with_clashing_names_and_one_id(spark):
    df = spark.createDataFrame([(3, [float(i), 1.0], i, "s", 0, 7) for i in range(50)] + [(20, [1.0, -1.0], 0, "t", 1, 8)], "vec_id long, embedding array<float>, id int, x string, shard int, q int")
    q = topk_search.quantized(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk_search.search(q.where("id = 20"), q, 5, 7).collect()))
    assert got == [(20, k + 1, 3, 64 * 64 * (49 - k - 1)) for k in range(5)]


def test_search_never_overflows(spark):
    for x, fails in ((1e18, True), (3e7, True), (1e6, False)):
        q = topk_search.quantized(vectors(spark, [(0, [x] * 64, ""), (1, [x] * 64, "")]), "vec_id", "embedding")
        if fails:
            with pytest.raises(ArithmeticError):
                topk_search.search(q, q)
        else:
            v = int(np.floor(64 * float(np.float32(x))))
            assert {r.score for r in topk_search.search(q, q).collect()} == {64 * v * v}


def test_only_essential_lists_are_traversed():
    rng = np.random.default_rng(2)
    x = np.zeros((400, 12), np.int64)
    x[:, 0] = rng.integers(0, 3, 400) * 500
    x[np.arange(400), rng.integers(1, 12, 400)] = rng.integers(1, 5, 400)
    lists, seen = topk_search.Lists(np.arange(400), x), []
    whole = lists.traverse
    lists.traverse = lambda terms, *a: seen.append(list(terms)) or whole(terms, *a)
    q = np.arange(1, 13)[::-1].copy()
    ids, scores = lists.top(-1, q, 10)
    want = sorted(((-int(q @ v), i) for i, v in enumerate(x)))[:10]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want
    assert 0 < sum(map(len, seen)) < 12
    # with a score to beat that no vector can reach, nothing is left to do
    assert len(lists.top(-1, q, 10, 10**9)[0]) == 0


def test_search_of_few(spark):
    q = topk_search.quantized(vectors(spark, [(0, [1.0], ""), (1, [2.0], "")]), "vec_id", "embedding")
    assert [tuple(r) for r in topk_search.search(q.where("id = 0"), q).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk_search.search(q.where("false"), q.where("false")).count() == 0


# --- 3


def test_escapes():
    random.seed(0)
    bits = [*chat_format.CONTROL, "\\", "<", ">", "[", "/", "s", "\n", "|", "é"]
    for _ in range(3000):
        t = "".join(random.choices(bits, k=8))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


def test_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="see <|image|>"), part(type="image", ref="i", width=28, height=15), part(type="audio", ref="a", seconds=1.5), part(type="document", ref="d", pages=2), part(type="text", text=" ok")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = {x.turn: x for x in chat_format.format_turns(df).collect()}
    assert chat_format.read_turns(r[0].segment) == [("assistant", "see <|image|> ok")] and chat_format.read_turns(r[1].segment) == [("", "")]
    assert [(a.kind, a.ref, a.tokens) for a in r[0].attachments] == [("image", "i", 4), ("audio", "a", 38), ("document", "d", 512)]
    assert all(r[0].segment[a.at :].startswith(f"<|{a.kind}|>") for a in r[0].attachments)
    assert "".join(chat_format.unescape(r[0].segment[s.start : s.end]) for s in r[0].loss) == "see <|image|> ok"
    with pytest.raises(Exception, match="unknown part type"):
        chat_format.format_turns(df.withColumn("parts", F.transform("parts", lambda p: p.withField("type", F.lit("film"))))).collect()


def test_conversations(spark):
    rows = [(None, None, None, None), (1, 2, "assistant", "b\\"), (1, 1, "user", None), (1, 1, "user", "x"), (1, 2, "assistant", "b\\"), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nuser\nx\nassistant\nb\\\nassistant\nb\\\n") and (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 4, sha("b\\b\\"))
    assert got[None].turns_sha256 == sha("\n\n") and got[2].loss_chars == len(LONG)
    assert chat_format.digest(chat_format.format_turns(df.where("false"))).count() == 0


# --- 4


def without_repeats(rows, n):
    c = Counter(b[p : p + n] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if c[b[p : p + n]] > 1:
                m[p : p + n] = b"\1" * n
        out.append((d, len(b), sum(m), len(re.findall(b"\1+", m)), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return out


def repeats(df, **k):
    out = suffix_dedup.remove_repeats(df, **k)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return order(out.select("doc_id", "n_bytes", removed, F.size("spans").cast("long"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize(("length", "hot"), [(200, 8192), (40, 8192), (40, 1)])
def test_repeats(spark, length, hot):
    random.seed(length)
    base = ["".join(random.choices("abcdefgh é", k=random.randint(0, 700))) for _ in range(10)]
    rows = [(None, None), (1, ""), (2, "a" * 450), (2, "a" * 450), (3, "ab" * 300), (4, "a" * 199)]
    for i in range(40):
        t, u = random.choice(base), random.choice(base)
        a, b = sorted(random.choices(range(len(t) + 1), k=2))
        rows.append((10 + i, u[: random.randint(0, len(u))] + t[a:b] + "".join(random.choices("xyz ", k=random.randint(0, 60)))))
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, hot=hot) == order(without_repeats(rows, length))


def test_repeats_across_tiles():
    text = np.frombuffer(random.Random(0).randbytes(5000), np.uint8)
    data, at = np.concatenate([text, text]), np.array([0, len(text), 2 * len(text)])
    windows = Counter()
    for rows, starts, sizes in suffix_dedup.tiles(at, 200, 512):
        windows.update((r, p) for r, a, n in zip(rows, starts, sizes) for p in range(a, a + n - 199))
    assert set(windows.values()) == {1} and len(windows) == 2 * (5000 - 199) and len(data) == 10000


def test_repeats_of_odd_tables(odd, empty):
    short = odd.where("length(text) < 1000 OR text IS NULL")
    assert repeats(short) == order(without_repeats([x for x in ODD if len(x[1] or "") < 1000], 200))
    assert repeats(empty) == [] and len(repeats(odd)) == len(ODD)
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(odd, 10 + 1)


def test_texts_of_one_id_stay_apart(spark):
    # these two texts agree in pmod(xxhash64, 2^31 - 1)
    passage = " ".join(f"p{i}" for i in range(80))
    x, y = f"266300 {passage}", " ".join(["154359", *(hashlib.sha512(f"154359{j}".encode()).hexdigest() for j in "abc")])
    df = spark.createDataFrame([(None, x), (None, y), (1, f"other {passage}")], "doc_id long, text string")
    assert repeats(df) == order(without_repeats([(None, x), (None, y), (1, f"other {passage}")], 200))
    bench = spark.createDataFrame([("i1", " ".join(f"p{i}" for i in range(10))), ("i2", "q r s t u")], "item_id string, text string")
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.decontaminate(df, bench, 5).collect()) == [(4, 0), (81, 10), (81, 10)]


# --- 5


def linked(rows):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    has = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in has[g])
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            has[g].append(i)
    least = {}
    key = lambda d: (d is not None, d)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=key) if root(i) in least else d
    return order((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "most"), [(1024, 65536), (8, 65536), (8, 4)])
def test_near_copies(spark, block, most):
    random.seed(block)
    vocabulary = ["".join(random.choices("abcDEé", k=random.randint(1, 4))) for _ in range(200)]
    base = [random.choices(vocabulary, k=random.randint(3, 80)) for _ in range(12)] + [random.choices(vocabulary, k=900)]
    rows = []
    for i in range(200):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3, 12])):
            t[random.randrange(len(t))] = random.choice(vocabulary)
        rows.append((i, " ".join(t)))
    assert order(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=block, most=most).collect()) == linked(rows)


def test_near_copies_beyond_the_filter(spark, monkeypatch):
    # with more ids than the filter is for, a join finds the texts
    monkeypatch.setattr(jaccard_join, "BLOOM_IDS", 0)
    random.seed(6)
    base = [[f"w{random.randrange(90)}" for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 4])):
            t[random.randrange(40)] = f"x{random.randrange(9)}"
        rows.append((i if i % 7 else None, " ".join(t)))
    assert order(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == linked(rows)


def test_index_lists_keep_every_link():
    rng = np.random.default_rng(7)
    base = rng.choice(2**40, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.06, rng.integers(0, 2**40, 300).astype(np.uint64), base)[: rng.integers(250, 300)]) for _ in range(60)]
    order_ = jaccard_join.Order({})
    parts = [order_.prefix(s, jaccard_join.prefix_size(len(s))) for s in sets]
    n = np.array([len(p) for p in parts])
    t, c, z = np.concatenate(parts), np.repeat(np.arange(60), n), np.repeat([len(s) for s in sets], n)
    place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    for dealt in (False, True):
        short, long, _ = jaccard_join.index_lists(t, c, z, place, 75, np.full(len(t), dealt))
        lists = defaultdict(set)
        for x in short:
            lists[x] |= set(np.frombuffer(x, "<i8").tolist())
        for name, x in long:
            lists[name] |= set(np.frombuffer(x, "<i8").tolist())
        linked_ = {(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
        assert linked_ and all(any({a, b} <= m for m in lists.values()) for a, b in linked_)
    assert sum(map(len, short)) == 0 and len(long)


def test_rounds_leave_few_pairs_of_a_group(spark, monkeypatch):
    # one group of near copies: what the last step holds against each other doesn't grow with its square
    made, of = [], jaccard_join.open_pairs

    def counted(*k):
        pairs = of(*k)
        made.append((k[-1], pairs.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "open_pairs", counted)
    monkeypatch.setattr(jaccard_join, "EARLY", 1 << 30)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in random.sample(range(120), random.choice([1, 2, 3, 4])):
            t[k] = f"x{i}.{k}"
        rows.append((i, " ".join(t)))
    assert order(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), few=0).collect()) == linked(rows)
    assert [n for likeliest, n in made if not likeliest][0] < 2 * len(rows)


def test_passages_stand_out_among_many_shingles():
    # 12 texts of a task share a passage; 2 million other shingles don't hide it
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(map(str, rng.integers(0, 2**31, n)))
    shared = "a passage that many texts share"
    texts = [f"{word(20)} {shared}" for _ in range(12)] + [word(50_000) for _ in range(40)]
    found = pa.Table.from_batches(jaccard_join._frequent(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    order_ = jaccard_join.Order(dict(zip(found["slot"].to_pylist(), found["n"].to_pylist(), strict=True)))
    data, at = jaccard_join.text_buffer(pa.array([texts[0], shared]))
    own, passage = jaccard_join.shingle_sets(data, at)
    assert not np.isin(order_.prefix(own, len(own) - len(passage)), passage).any()


def test_near_copies_of_odd_tables(odd, empty):
    assert order(jaccard_join.jaccard_components(odd).collect()) == linked(ODD)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_sketches_never_overstate():
    rng = np.random.default_rng(0)
    for n, m in ((5, 7), (300, 400), (2000, 1800)):
        both = rng.integers(0, 2**63, max(n, m) // 2).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k).astype(np.uint64)])) for k in (n, m))
        assert jaccard_join.bits_apart(jaccard_join.wide_sketch_of(x), jaccard_join.wide_sketch_of(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and len(got) == 91


# --- 6


def test_pieces(spark, documents, odd, empty):
    model = public_tokenizers.path(piece_lattice.MODEL)
    sp = piece_lattice.processor(model)
    rows = [*documents[:60], *ODD, (20, "a▁b  ▁ c"), (21, " "), (22, "  a  b   c "), (23, "x" * 300)]
    got = order((r.doc_id, r.text, tuple(r.ids)) for r in piece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), model, chunk=20_000).collect())
    assert got == order((d, t or "", tuple(sp.encode(t or ""))) for d, t in rows)
    assert got == order((r.doc_id, r.text, tuple(r.ids)) for r in piece_lattice.encode_by_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert piece_lattice.encode_by_words(empty, model).count() == 0
    encoded = piece_lattice.encode(odd, model)
    assert all(r.decoded == r.text for r in piece_lattice.decode(encoded, model).collect() if "▁" not in r.text)
    assert all(r.round_trip for r in piece_lattice.digest(encoded, model).collect())
    assert piece_lattice.encode(empty, model).count() == 0
    with pytest.raises(ValueError):
        piece_lattice.encode(odd, model, "other")


def test_unigram_viterbi(spark, documents):
    model = public_tokenizers.path(piece_lattice.MODEL)
    pieces = {r.piece: (r.id, r.score) for r in piece_lattice.piece_table(spark, model).collect()}

    def best(word):
        at = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            at.append(min((at[s][0] + (-pieces[word[s:e]][1] if word[s:e] in pieces else 1e6), s) for s in range(max(0, e - 16), e) if word[s:e] in pieces or s == e - 1))
        out, e = [], len(word)
        while e:
            s = at[e][1]
            out = ([pieces[word[s:e]][0]] if word[s:e] in pieces else [b + 3 for b in word[s:e].encode()]) + out
            e = s
        return out

    for r in piece_lattice.encode(spark.createDataFrame([*documents[:5], (99, "漢字 ① q")], "doc_id long, text string"), model, "unigram").collect():
        assert r.ids == [i for w in piece_lattice.words_of_text(r.text) for i in best(w)]


# --- 7 and 9


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def ids_of(texts):
    at, ids = WordEncoder(public_tokenizers.path(TOKENIZER)).ids_of(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("mixed", [False, True])
def test_word_encoder(mixed):
    random.seed(3)
    bits = [" ", " ", "  ", "\n", "\n", "\t", "a", "bc", "The", "é", "漢", "1", "23", "'s", "'", ",", ".", "!!", "|", "\u3000", "\u200b", "<|endoftext|>", "ſ", "\x00", "\x01", "\x1c", "\x85", "\r\n", "ﬁ", "²"]
    if not mixed:  # the texts that are worked on as a column
        bits = [" ", "\n", "a", "bc", "The", "é", "漢", "23", "'s", "'", ",", ".", "!!", "\u200b", "\x00", "²"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(8000)]
    assert ids_of(texts) == library_ids(texts)
    assert ids_of([]) == []


def test_word_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(_byte_bpe, "CACHED_WORDS", 50)
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcde", k=4)) for _ in range(30)) for _ in range(50)]
    enc = WordEncoder(public_tokenizers.path(TOKENIZER))
    for i in range(0, 50, 5):
        at, ids = enc.ids_of(pa.array(texts[i : i + 5]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library_ids(texts[i : i + 5])


def test_added_tokens_as_by_default(spark):
    random.seed(4)
    bits = [" ", "  ", "\n", "a", "The", "é", "1", ".", "<|", "|>", "<|endoftext|>", "<|endoftext|>", "endoftext"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", *("".join(random.choices(bits, k=random.randint(0, 9))) for _ in range(3000))]
    want = library_ids(texts)
    assert want[0] == [64, 50256, 65] and ids_of(texts) == want
    rows = list(enumerate(texts[:200]))
    got = sorted(map(tuple, token_files.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path(TOKENIZER)).collect()))
    assert [(d, n) for d, _, n, _ in got] == [(d, len(ids) + 1) for (d, _), ids in zip(rows, want)]
    assert [c for *_, c in got] == [zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, 2)) for ids in want[:200]]


def test_token_counts(spark, odd, empty):
    n = np.array([len(x) for x in library_ids([t for _, t in ODD])])
    path = public_tokenizers.path(TOKENIZER)
    sums = token_counts.suffix_sums(token_counts.lengths(odd, path)).cache()
    for r in sums.collect():
        at = r.context_limit
        assert (r.docs, r.docs_reaching, r.docs_cut, r.tokens_kept, r.tokens_reaching) == ((n == at).sum(), (n >= at).sum(), (n > at).sum(), np.minimum(n, at).sum(), n[n >= at].sum())
    for r in token_counts.at_limits(sums, [0, 1, 7, 4000, 10**6]).collect():
        assert (r.tokens_kept, r.docs_cut) == (np.minimum(n, r.context_limit).sum(), (n > r.context_limit).sum())
    assert {r.q: r.length for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {q: int(np.quantile(n, q, method="inverted_cdf")) for q in (0.5, 1.0)}
    assert token_counts.suffix_sums(token_counts.lengths(empty, path)).count() == 0


def test_token_files(spark, documents, odd, empty, tmp_path):
    path = public_tokenizers.path(TOKENIZER)
    rows = documents[:50]
    got = sorted(map(tuple, token_files.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()))
    start = 0
    for (d, _), ids, r in zip(rows, library_ids([t for _, t in rows]), got, strict=True):
        ids = [*ids, 2]
        assert r == (d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_files.token_digest(odd, path).count() == len(ODD)
    assert token_files.token_digest(empty, path).count() == 0
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f"), path, frame_bytes=2000, file_bytes=4000)
    files = sorted((tmp_path / "f").glob("part-*"))
    assert len(files) > 4
    found = {}
    for f in files:
        found |= token_files.read_documents(f.read_bytes(), {3, 17})
    assert {k: v.tolist() for k, v in found.items()} == {d: [*library_ids([t])[0], 2] for d, t in rows if d in (3, 17)}
    broken = bytearray(files[0].read_bytes())
    entries, _ = token_files.seek_table(bytes(broken))
    with pytest.raises(ValueError):
        token_files.read_frame(bytes(broken[: entries[0][0]]), (entries[0][0], entries[0][1], entries[0][2] ^ 1, 0, 0))


# --- 8


def test_urls(spark, sf):
    urls = [None, "abc", "http://A.COM/en/x?y", "x://example.com/en/7#", "http://com/en", "http://xcom/en/", "a://b://c/", "http://m.example.net/de/80", "http://net/de/1", "", "h://", "h://q.org/es/\n#x"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, score int")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(got[i].host, got[i].path) for i in range(8)] == [("", ""), ("", ""), ("a.com", "/en/x"), ("example.com", "/en/7"), ("com", "/en"), ("xcom", "/en/"), ("b:", "//c/"), ("m.example.net", "/de/80")]
    assert [got[i].rule for i in range(12)] == [None, None, "com/en/", "example.com/en/7", None, None, None, "example.net/de/8", "net/de/", None, None, "org/es/"]
    assert [got[i].verdict for i in (2, 3, 7, 8, 11)] == ["block", "allow", "block", "allow", "block"]
    assert url_filter.judge(df.where("false")).count() == 0


def test_whole_urls_are_scored(spark):
    rules = [("allow", "good.com/"), ("block", "bad.com/")]
    urls = [f"http://{h}.com/{i}?{q}={i}" for i in range(60) for h, q in (("good", "page"), ("bad", "zzqx"))]
    asked = ["http://mid.org/1?page=7", "http://mid.org/1?zzqx=7", "mid.org/page=7", "mid.org/zzqx=7", "http://mid.org/1#page=7", "http://mid.org/1#zzqx=7", None, ""]
    df = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    got = {r.page_id - len(urls): r for r in url_filter.judge(df, rules).collect()}
    assert [got[i].verdict for i in range(6)] == ["allow", "block"] * 3 and got[0].score > got[1].score
    assert got[6].score == got[7].score == 0.0 and all(got[i].score != 0 for i in range(6))


@pytest.mark.parametrize("shared", [None, 4])
def test_pages_of_one_id_are_learned_from(spark, shared):
    rules = [("allow", "good.com/"), ("block", "bad.com/")]
    urls = [f"http://{h}.com/{i}?{q}={i}" for i in range(60) for h, q in (("good", "page"), ("bad", "zzqx"))] + ["http://mid.org/1?page=7", "http://mid.org/1?zzqx=7"]
    df = spark.createDataFrame([(shared, u) for u in urls], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge(df, rules).where("host = 'mid.org'").collect()) == ["allow", "block"]


def test_verdicts_by_brute_force(spark, sf):
    rng, k = random.Random(8), url_filter.ORDER
    hosts, words = ["a.com", "shop.net", "b.org", "mid.io", "x.dev"], ["en", "de", "item", "page", "zz9", "q"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(words)}/{rng.randrange(50)}?{rng.choice(words)}={rng.randrange(9)}" for _ in range(400)] + [None, "", "é://a.com/ü"]
    rules = [("allow", "a.com/"), ("block", "shop.net/"), ("block", "b.org/en")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}

    def ruled(u):
        host, _, path = (u or "").partition("://")[2].partition("/")
        fits = [(v, r) for v, r in rules if host == r.partition("/")[0] and ("/" + path).startswith("/" + r.partition("/")[2])]
        return max(fits, key=lambda x: len(x[1]))[0] if fits else None

    def padded(u):
        return b"\2" * k + (u or "").encode() + b"\3"

    sides, apart = {"allow": [], "block": []}, []
    for i, u in enumerate(urls):
        if ruled(u):
            (apart if zlib.crc32(f"{i} {u or ''}".encode()) % 5 == 0 else sides[ruled(u)]).append((ruled(u), u))
    assert apart and all(sides.values())

    def model(texts):
        total, count, kinds = Counter(), Counter(), defaultdict(set)
        for u in map(padded, texts):
            for i in range(k, len(u)):
                for o in range(k + 1):
                    total[u[i - o : i]] += 1
                    count[u[i - o : i + 1]] += 1
                    kinds[u[i - o : i]].add(u[i])
        return total, count, kinds

    models = {v: model(u for _, u in rows) for v, rows in sides.items()}

    def score(u):
        if not u:
            return 0.0
        x, out = padded(u), 0.0
        for sign, (total, count, kinds) in ((1, models["allow"]), (-1, models["block"])):
            for i in range(k, len(x)):
                p = 1 / 256
                for o in range(k + 1):
                    c = x[i - o : i]
                    if total[c]:
                        p = (count[x[i - o : i + 1]] + len(kinds[c]) * p) / (total[c] + len(kinds[c]))
                out += sign * np.log(p)
        return out / (len(x) - k)

    for i, u in enumerate(urls):
        assert got[i].score == pytest.approx(score(u), abs=1e-9)
    # the threshold that judges the set apart best, each side weighed alike; of equal ones the middle one
    bins = [(v, int((min(max(score(u), -10), 10) + 10) / 20 * 2000)) for v, u in apart]
    n = Counter(v for v, _ in bins)
    gain = [sum(v == "block" and b < t for v, b in bins) / n["block"] + sum(v == "allow" and b >= t for v, b in bins) / n["allow"] for t in range(2002)]
    best = [t for t, g in enumerate(gain) if g >= max(gain) - 1e-12]
    limit = best[len(best) // 2] / 2000 * 20 - 10
    assert [got[i].verdict for i in range(len(urls))] == [ruled(u) or ("allow" if score(u) >= limit else "block") for u in urls]
    assert len({got[i].verdict for i, u in enumerate(urls) if not ruled(u)}) == 2


def test_markov_against_counts():
    urls = ["a.com/x", "a.com/y1", "b.net/de/1", "b.net/de/22"]
    data, at = url_filter.text_buffer(__import__("pyarrow").array(urls))
    grams = list(url_filter._grams(data, at))
    m = url_filter.Markov()
    for _, c, g in grams:
        v, first, n = np.unique(g, return_index=True, return_counts=True)
        m.add(c[first], v, n)
    got = m.log(grams, len(urls))
    k = url_filter.ORDER
    total, count, kinds = Counter(), Counter(), defaultdict(set)
    padded = ["\2" * k + u + "\3" for u in urls]
    for u in padded:
        for i in range(k, len(u)):
            for o in range(k + 1):
                total[o, u[i - o : i]] += 1
                count[o, u[i - o : i], u[i]] += 1
                kinds[o, u[i - o : i]].add(u[i])
    for u, x in zip(padded, got):
        s = 0.0
        for i in range(k, len(u)):
            p = 1 / 256
            for o in range(k + 1):
                c = (o, u[i - o : i])
                p = (count[(*c, u[i])] + len(kinds[c]) * p) / (total[c] + len(kinds[c])) if total[c] else p
            s += np.log(p)
        assert abs(s - x) < 1e-4


def test_models_of_many_grams(spark):
    rng, k = random.Random(5), url_filter.ORDER
    urls = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", k=40)) for _ in range(6000)]
    good, _ = url_filter.fit(spark.createDataFrame([(u, True) for u in urls] + [("x", False)], "said string, allowed boolean"))
    padded = ["\2" * k + u + "\3" for u in urls]
    count = Counter((o, u[i - o : i + 1]) for u in padded for i in range(k, len(u)) for o in range(k + 1))
    total, kinds = Counter(), Counter()
    for (o, g), n in count.items():
        total[o, g[:-1]] += n
        kinds[o, g[:-1]] += 1
    data, at = url_filter.text_buffer(__import__("pyarrow").array(urls[:200]))
    for u, x in zip(padded, good.log(list(url_filter._grams(data, at)), 200)):
        s = 0.0
        for i in range(k, len(u)):
            p = 1 / 256
            for o in range(k + 1):
                c = (o, u[i - o : i])
                p = (count[o, u[i - o : i + 1]] + kinds[c] * p) / (total[c] + kinds[c])
            s += np.log(p)
        assert abs(s - x) < 1e-6


# --- 10


def test_benchmark_by_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = c.execute(sql)
        columns = [x[0] for x in want.description]
        assert order(queries.queries()[name](spark, sf).select(*columns).collect()) == order(want.fetchall()), name


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_benchmark_windows(spark, odd, empty, block):
    items = [("i1", "x a b c d e f g h i j"), ("i2", "ONE, two"), ("i3", "two"), ("i4", None), ("i5", "..."), (None, "other"), ("i1", "k")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = lambda d: decontaminate.decontaminate(d, bench, block)
    rows = found(odd).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_words, r.n_hit, r.item_ids))
    assert len(rows) == len(ODD) and got[7] == [(11, 11, ["i1"])] and got[4] == [(2, 2, ["i2", "i3"])] * 2 and got[1] == [(0, 0, [])] and sorted(got[9])[1] == (1, 1, [])
    assert found(empty).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(odd, bench.where("false")).collect())
