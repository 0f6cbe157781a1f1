"""The corpus operators against brute force, and their edge cases."""

import collections
import datetime as dt
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstream.llm import langid
from loomstream.llm.bpe_fst import default_tokenizer_path
from loomstream.llm.exact_dedup import exact_dedup
from loomstream.llm.jaccard_join import jaccard_components
from loomstream.llm.lm_scoring import lm_scores
from loomstream.llm.mixing import marginals, mix
from loomstream.llm.packing import Bins, pack_documents, pack_lengths
from loomstream.llm.pii import ANY, NAME, PATTERNS, pseudonymise
from loomstream.llm.suffix_dedup import remove_repeats
from loomstream.llm.token_counts import token_counts
from loomstream.llm.topk import exact_topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, score double, hash string"
WORDS = ["the", "of", "and", "river", "stone", "green", "walks", "über", "café", "I'm", "12", "!!", "日本"]


def corpus():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, special strings."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) + str(rng.randrange(40)) for _ in range(n))
    texts = [None, "", " \n ", "a", "a  a\tb", "a a b", "<|endoftext|> x<|endoftext|>", "don't  we'll\n\n go 'S", "ab" * 400, prose(3000)]
    base, passage = prose(120), prose(60)
    for i in range(12):
        words = base.split()
        words[rng.randrange(120)] = f"changed{i}"
        texts.append(" ".join(words))
    texts += [base, base, prose(80) + " " + passage + " " + prose(50), passage, "x " + passage, prose(4), prose(4)]
    texts += [prose(rng.randrange(1, 200)) for _ in range(15)]
    return [(i, t, None if i % 7 == 0 else ("de" if i % 2 else "en"), None if i % 5 == 0 else f"s{i % 3}", 1, i, 0.5, "h") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    data = corpus()
    return [*data, data[30], (None, "lonely text", "en", "s1", 1, 1, 0.5, "h")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, rows, empty):
    library = Tokenizer.from_file(default_tokenizer_path())
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, limit=20).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 20) for r in rows)
    assert token_counts(empty).count() == 0


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(default_tokenizer_path())
    out = pack_documents(docs, capacity=256).collect()
    used = collections.defaultdict(list)
    pieces = collections.defaultdict(dict)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["piece"]] = r
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, r in pieces[doc_id].items():
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert p == 0 or r["length"] == 256
        assert sum(r["length"] for r in pieces[doc_id].values()) == len(ids)
    plain = Bins(256)
    plain.best_fit(np.array([r["length"] for r in out]))
    assert -(-sum(r["length"] for r in out) // 256) <= len(used) <= len(plain.items)
    assert pack_documents(empty).count() == 0


def test_local_search_empties_bins():
    lengths = np.random.default_rng(1).integers(500, 1500, 3000)
    plain = Bins(2048)
    plain.best_fit(lengths)
    before = sum(1 for f in plain.fill if f)
    squares = sum(f * f for f in plain.fill)
    plain.improve()
    assert sum(1 for f in plain.fill if f) < before and sum(f * f for f in plain.fill) > squares
    number, offset = pack_lengths(lengths, 2048)
    assert np.bincount(number, lengths).max() <= 2048 and sorted(x for b in plain.items for x in b) == sorted(lengths.tolist())


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(docs, rows, empty, digest_all):
    import re

    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = exact_dedup(docs, digest_all=digest_all).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(groups)
    want = {i: (min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    assert all((r["keep_id"], r["group_size"]) == want[r["doc_id"]] for r in out)
    if digest_all:
        text = {r[0]: norm(r[1]) for r in rows}
        assert all(r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)
    assert exact_dedup(empty, digest_all=digest_all).count() == 0


def test_jaccard_components(docs, rows, empty):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    data = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in data:
        for b in data:
            if a < b and data[a] and 100 * len(data[a] & data[b]) >= 80 * len(data[a] | data[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = [r for r in jaccard_components(docs).collect() if r["doc_id"] is not None]
    assert len(out) == len(rows) - 1
    assert all((r["n_shingles"], r["component_id"]) == (len(data[r["doc_id"]]), root(r["doc_id"])) for r in out)
    assert len({r["component_id"] for r in out}) < len(data)
    assert jaccard_components(empty).count() == 0


def test_jaccard_large_regions(spark, monkeypatch):
    """Regions cut in blocks, and recursion, give the same components."""
    from loomstream.llm import jaccard_join

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    assert whole == {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(56)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert whole == {i: root(i) for i in sets}


@pytest.mark.parametrize("hot", [1000, 1])
def test_remove_repeats(docs, rows, empty, hot, monkeypatch):
    from loomstream.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    length = 100
    count = collections.Counter(b[i : i + length] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - length + 1))
    want = {}
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        want[r[0]] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    out = remove_repeats(docs, length=length).collect()
    assert len(out) == len(rows) and sum(r["n_removed"] > 0 for r in out) > 10
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in out)
    assert remove_repeats(empty).count() == 0


def test_index_family_matches_across_batches():
    from loomstream.llm.suffix_dedup import IndexFamily

    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[2000:2300] = raw[100:400]
    family = IndexFamily(50)
    for i in range(0, 3000, 500):  # batches of whole windows only
        family.add(raw[i : i + 500], np.arange(451))
    windows = [raw[i + k : i + k + 50].tobytes() for i in range(0, 3000, 500) for k in range(451)]
    count = collections.Counter(windows)
    assert family.matches().tolist() == [count[w] > 1 for w in windows] and len(family.levels) <= 4


def test_lm_scores(docs, rows, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(r[0], [*(r[1] or "").encode().lower().split(), b" end"]) for r in rows]
    c = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = {i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words}
    out = lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(out) == len(rows)
    for r in out:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6
        assert r["score"] < 0
    assert lm_scores(empty, F.lit(False)).count() == 0


def brute_ppm(learn, texts, order=5):
    """log10 probability of each text and its end: contexts from long to short, a dictionary of counts each."""
    counts = collections.defaultdict(collections.Counter)
    path = lambda t: [(t[max(0, i - order) : i] if i >= order else [256] * (order - i) + t[:i], t[i] if i < len(t) else 256) for i in range(len(t) + 1)]
    for t in learn:
        for context, byte in path(list(t)):
            for k in range(order + 1):
                counts[tuple(context[order - k :])][byte] += 1
    alphabet = [b for b in range(257) if not 65 <= b <= 90]

    def probability(context, byte):
        gone, p = set(), 1.0
        for k in range(order, -1, -1):
            own = {b: c for b, c in counts[tuple(context[order - k :])].items() if b not in gone}
            if not own:
                continue
            new = len(own) if len(own) + len(gone) < len(alphabet) else 0
            if byte in own:
                return p * own[byte] / (sum(own.values()) + new)
            p *= new / (sum(own.values()) + new)
            gone |= own.keys()
        return p / (len(alphabet) - len(gone))

    return [sum(math.log10(probability(c, b)) for c, b in path(list(t))) for t in texts], probability, alphabet


def test_ppm_is_a_distribution():
    _, probability, alphabet = brute_ppm([b"abracadabra", b"bar \xc3\xbc", b""], [])
    for context in ([256] * 5, list(b"abrac"), list(b"zzzra"), list(b"zzzzz")):
        assert abs(sum(probability(context, b) for b in alphabet) - 1) < 1e-12


@pytest.mark.parametrize("head", [10**6, 50, 0])
def test_lm_scores_against_brute_force(spark, docs, rows, head):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    some = [r for r in rows if len(r[1] or "") < 1500]
    texts = [(r[1] or "").encode().lower() for r in some]
    want, _, _ = brute_ppm([t for r, t in zip(some, texts, strict=True) if not held(r[0])], texts)
    want = dict(zip([r[0] for r in some], want, strict=True))
    out = lm_scores(docs.where("length(text) < 1500 OR text IS NULL"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, head_keys=head, head_words=head).collect()
    assert len(out) == len(some) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 * max(1, -want[r["doc_id"]]) for r in out)


def test_lm_scores_read_long_texts_in_steps(spark, monkeypatch):
    from loomstream.llm import lm_scoring

    data = [(1, "alpha beta gamma " * 300), (2, "x" * 3000), (3, "beta alpha " * 50)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in lm_scores(frame, F.lit(False)).collect()}
    at, low = np.array([0, 5100, 8100]), np.frombuffer((data[0][1] + data[1][1]).encode(), np.uint8)
    every = [np.concatenate(c) for c in zip(*lm_scoring.keys_of(at, low), strict=True)]
    monkeypatch.setattr(lm_scoring, "STEP", 100)
    steps = [np.concatenate(c) for c in zip(*lm_scoring.keys_of(at, low), strict=True)]
    assert all((a == b).all() for a, b in zip(every, steps, strict=True)) and len(every[0]) == 8102
    want, _, _ = brute_ppm([t.encode() for _, t in data], [t.encode() for _, t in data])
    assert all(abs(whole[i][-1] - w) < 1e-6 * -w for (i, _), w in zip(data, want, strict=True))


def test_langid(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(real.where(~held), check_rows=500)
    found = langid.predict(real.where(held).select("doc_id", "text"), model).join(real.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    clean = langid.predict(real.where(held), model)
    assert clean.where(F.col("known") < model.floor).isEmpty()
    strange = spark.createDataFrame([("Zqxj vvkq xqzz jjqk wxyz qqqq vxkj bnmpt",), ("これは日本語の文章です まだ続きます",), ("12 + 3 = 15",)], "text string")
    assert [r["known"] < model.floor for r in langid.predict(strange, model).collect()] == [True] * 3
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and out[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.train(empty) is None and {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_langid_learns_from_all_rows(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    frame = spark.createDataFrame([(i, f"{name(i)} {name(i)} the", "ab"[i % 2]) for i in range(6000)], "doc_id long, text string, lang string")
    model = langid.train(frame)
    index, values = model.tables[0]
    assert set(index) == {"the", *map(name, range(6000))}
    assert np.allclose(np.exp(values[index["the"]]), 3000.1 / (3 * 3000 + 0.1 * 6001))
    # Rarer words are left to their n-grams, in which they are counted all the same.
    rare = langid.train(frame, rare=0.01)
    assert set(rare.tables[0][0]) == {"the"} and rare.tables[1][0].keys() == {*"abcdefghij the"}
    known = spark.range(1000).select((F.col("id") * 37 % 1000 / 1000).alias("known"))
    assert langid.floor_of(known) == 0.009 / 2 and langid.floor_of(known.limit(0)) == 0.0


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [None] + [0.1] * 15), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (304, vectors[3][1]), (305, vectors[3][1]), (50, vectors[50][1]), (400, [0.5]), (None, vectors[1][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = exact_topk(df, df.where("vec_id % 50 = 0"), k=5, block=64, query_block=4).collect()
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-int(x @ v), i) for i, v in ok if i != q and len(v) == len(x))[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert exact_topk(df.limit(0), df).count() == 0


def brute_mix(rows, budget, temper=0.5, rounds=60):
    """The probability of each (source, lang, topic): dual scaling of capped cells, plainly."""
    import re

    def topic(t):
        for name, test in (("table", " | " in t), ("noise", re.search("[#$%&*]{3}", t)), ("numeric", re.search("[0-9]{6}", t)), ("note", len(t.encode()) < 600)):
            if test:
                return name
        return "prose"

    cells = collections.Counter()
    for r in rows:
        cells[r[3], r[2], topic(r[1] or "")] += max(1, (len((r[1] or "").encode()) + 3) // 4)
    want = {c: budget * n for c, n in cells.items()}
    aims = []
    for d in range(3):
        has = collections.Counter()
        for c, n in cells.items():
            has[c[d]] += n
        low, high = 0.0, 1e12
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(n, level * n**temper) for n in has.values()) < budget * sum(has.values()) else (low, level)
        aims.append({k: min(n, low * n**temper) for k, n in has.items()})
    for _ in range(rounds):
        for d, aim in enumerate(aims):
            for k, x in aim.items():
                own = [c for c in cells if c[d] == k]
                low, high = 0.0, 1e9  # the factor by bisection
                for _ in range(100):
                    f = (low + high) / 2
                    low, high = (f, high) if sum(min(cells[c], f * want[c]) for c in own) < x * (1 - 1e-12) else (low, f)
                for c in own:
                    want[c] *= high
    return {c: min(1.0, want[c] / n) for c, n in cells.items()}, topic


def test_mix(spark, docs, rows, empty):
    assert mix(empty).count() == 0
    for budget in (0.5,):
        want, topic = brute_mix(rows, budget)
        out = mix(docs, budget=budget, rounds=8).collect()
        assert len(out) == len(rows)
        got = {(r["mix_source"], r["mix_lang"], r["mix_topic"]): r["mix_probability"] for r in out}
        assert got.keys() == want.keys() and all(abs(got[c] - p) < 0.01 for c, p in want.items())
        assert {r["doc_id"]: r["mix_topic"] for r in out} == {r[0]: topic(r[1] or "") for r in rows}
        n = sum(r["mix_tokens"] for r in out)
        assert abs(sum(r["mix_tokens"] * r["mix_probability"] for r in out) - budget * n) < 0.01 * n and out[0]["mix_residual"] < 0.01
    fixed = mix(docs, targets={"lang": {"en": 3.0, "de": 1.0}}, budget=0.1, rounds=8)
    assert fixed.where("mix_lang IS NULL").agg(F.max("mix_probability")).first()[0] == 0
    kept = {r["category"]: r["expected"] for r in marginals(fixed).where("dimension = 'lang'").collect()}
    assert abs(kept["en"] / kept["de"] - 3) < 0.05


def test_mix_keeps_what_it_promises(spark):
    data = [(i, f"s{i % 7}", "en" if i % 5 else "de", "word " * (10 + i % 90)) for i in range(20000)]
    out = mix(spark.createDataFrame(data, "doc_id long, source string, lang string, text string"), budget=0.3, rounds=4)
    share = {}
    for column in ("tokens", "expected", "kept"):
        by = {r["category"]: r[column] for r in marginals(out).where("dimension = 'lang'").collect()}
        share[column] = by["de"] / sum(by.values())
    root = share["tokens"] ** 0.5
    aim = root / (root + (1 - share["tokens"]) ** 0.5)
    assert abs(aim - share["tokens"]) > 0.1 and abs(share["expected"] - aim) < 1e-4 and abs(share["kept"] - aim) < 0.02


def test_pii(spark, empty):
    valid = "4539578763621486"
    text = f"Mail a.b@x.example.org or call +1 (017) 555-7713, 017-555-7713; card {valid} and 4539 5787 6362 1486, not 4539578763621487; ip 10.0.0.255 not 10.0.0.256; born 1999-02-28 not 1999-02-30; 123-45-6789 not 000-12-3456."
    docs = spark.createDataFrame([(1, text, 1), (2, f"again {valid} on 1999-02-28", 1), (3, None, 1), (4, "", 1), (5, "nothing here 12", 1), (5, "nothing here 12", 1)], "doc_id long, text string, found int")
    out = pseudonymise(docs, key="k").collect()
    by = {r["doc_id"]: r for r in out}
    one = by[1]["text"]
    assert (by[1]["n_email"], by[1]["n_phone"], by[1]["n_card"], by[1]["n_ip"], by[1]["n_date"], by[1]["n_ssn"]) == (1, 2, 2, 1, 1, 1)
    for gone in ("a.b@", "555-7713", valid, "10.0.0.255 ", "1999-02-28", "123-45-6789"):
        assert gone not in one
    for stays in ("4539578763621487", "10.0.0.256", "1999-02-30", "000-12-3456", "@x.example.org", "+1 ("):
        assert stays in one
    card = one.split("card ")[1][:16]
    assert sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(card))) % 10 == 0
    assert card in by[2]["text"] and by[2]["text"].split(" on ")[1] in one and card == one.split("and ")[1][:19].replace(" ", "")
    assert by[3]["text"] is None and by[4]["text"] == "" and by[5]["text"] == "nothing here 12" and len(out) == 6
    assert pseudonymise(empty, key="k").count() == 0


class PiiTwin:
    """The pseudonyms again, value by value in plain Python."""

    def __init__(self, key):
        self.key = hashlib.sha256(key.encode()).hexdigest()

    def digest(self, *parts):
        return hashlib.sha256(":".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def pair(self, kind, a, b, n_a, n_b):
        for i in range(4):
            a = (a + int(self.digest(kind, 2 * i, b)[:15], 16) % n_a) % n_a
            b = (b + int(self.digest(kind, 2 * i + 1, a)[:15], 16) % n_b) % n_b
        return a, b

    @staticmethod
    def luhn(d, odd=0):
        return sum(sum(divmod(int(c) * 2, 10)) if (i + odd) % 2 else int(c) for i, c in enumerate(reversed(d)))

    @staticmethod
    def like(m, chars, test=str.isdigit):
        it = iter(chars)
        return "".join(next(it) if test(c) else c for c in m)

    def card(self, m):
        d = "".join(filter(str.isdigit, m))
        k = (len(d) - 1) // 2
        a, b = self.pair("card", int(d[:k]), int(d[k:-1]), 10**k, 10 ** (len(d) - 1 - k))
        payload = f"{a:0{k}}{b:0{len(d) - 1 - k}}"
        return self.like(m, payload + str(-self.luhn(payload, 1) % 10))

    def run(self, m):
        groups = re.split("([ -])", m)
        out, i = "", 0
        while i < len(groups):
            for j in range(min(len(groups), i + 2 * 19), i, -1):
                d = "".join(groups[i:j:2])
                if (j - i) % 2 and 13 <= len(d) <= 19 and self.luhn(d) % 10 == 0:
                    out += self.card("".join(groups[i:j]))
                    i = j
                    break
            else:
                out += groups[i]
                i += 1
            out += groups[i] if i < len(groups) and i % 2 else ""
            i += i % 2
        return out

    def __call__(self, m):
        if "@" in m:
            local, domain = m.lower().split("@")
            chars = "".join(c for c in local if c in NAME)
            a, b = chars[: len(chars) // 2], chars[len(chars) // 2 :]
            move = lambda s, h: "".join(NAME[(NAME.index(c) + int(h[2 * (p % 32) :][:2], 16)) % 36] for p, c in enumerate(s))
            for i in range(4):
                a = move(a, self.digest("email", 2 * i, "@" + domain, b))
                b = move(b, self.digest("email", 2 * i + 1, "@" + domain, a))
            return self.like(local, a + b, NAME.__contains__) + m[m.index("@") :]
        if re.fullmatch(PATTERNS["ip"], m):
            o = [int(x) for x in m.split(".")]
            a, b = self.pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}" if max(o) < 256 else m
        if re.fullmatch(PATTERNS["date"], m):
            try:
                day = (dt.date.fromisoformat(m) - dt.date(1900, 1, 1)).days
            except ValueError:
                return m
            a, b = self.pair("date", day // 4297, day % 4297, 17, 4297)
            return str(dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b))
        if re.fullmatch(PATTERNS["ssn"], m):
            x, y, z = (int(p) for p in m.split("-"))
            if not (0 < x < 900 and x != 666 and y and z):
                return m
            a, b = self.pair("ssn", x - 1 - (x > 666), (y - 1) * 9999 + z - 1, 898, 99 * 9999)
            return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
        if re.fullmatch(PATTERNS["phone"], m):
            d = "".join(filter(str.isdigit, m))
            a, b = self.pair("phone", int(d[-10:-5]), int(d[-5:]), 100000, 100000)
            return self.like(m, f"{d[:-10]}{a:05}{b:05}")
        return self.run(m)


def test_pii_against_a_plain_twin(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def number():
        kind = rng.randrange(8)
        payload = digits(rng.choice([12, 14, 15, 18]))
        card = payload + str(-PiiTwin.luhn(payload, 1) % 10)
        return [
            card, " ".join(card[i : i + 4] for i in range(0, len(card), 4)), f"{digits(rng.randrange(1, 5))} {card}", f"{rng.randrange(1, 256)}.{rng.randrange(300)}.0.7", f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 33):02}",
            f"{digits(3)}-{digits(2)}-{digits(4)}", rng.choice(["+1 (", "("]) + f"{digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)}-{digits(3)}-{digits(4)} {card}-{digits(2)}x",
        ][kind]

    texts = [" ".join(rng.choice([number(), rng.choice(["word", "a.B+c@Mail.example", "x@y.zz", "end.", "-"])]) for _ in range(30)) for _ in range(120)]
    texts += ["item 1 4539578763621486 paid", "12 4539 5787 6362 1486", "1234 4539 5787 6362 1486 77", "123 017-555-7713", "4539578763621486 4539578763621486"]
    out = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()}
    twin = PiiTwin("k")
    for i, t in enumerate(texts):
        assert out[i]["text"] == re.sub(ANY, lambda m: twin(m.group()), t), t
    assert [out[120 + i]["n_card"] for i in range(5)] == [1, 1, 1, 0, 2] and out[123]["n_phone"] == 1 and "4539" not in out[120]["text"]


def test_pseudonyms_are_permutations(spark):
    day = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    out = pseudonymise(spark.range(73049).select(F.col("id").alias("doc_id"), day.alias("text")), key="k")
    assert out.agg(F.count_distinct("text"), F.min("text"), F.max("text"), F.sum("n_date")).first()[:] == (73049, "1900-01-01", "2099-12-31", 73049)
    two = F.concat(F.substring(F.lit(NAME), 1, 0), *(F.substr(F.lit(NAME), F.floor(F.col("id") / n) % 36 + 1, F.lit(1)) for n in (1, 36)), F.lit("@e.org"))
    assert pseudonymise(spark.range(36 * 36).select(F.col("id").alias("doc_id"), two.alias("text")), key="k").select("text").distinct().count() == 36 * 36


def test_feistel_is_a_permutation(spark):
    from loomstream.llm.pii import feistel

    grid = spark.range(7 * 13).select(feistel("k", "x", F.floor(F.col("id") / 13), F.col("id") % 13, F.lit(7), F.lit(13)).alias("p")).select("p.*").collect()
    assert {(r["l"], r["r"]) for r in grid} == {(a, b) for a in range(7) for b in range(13)}


CLASHING = {"mix_kept": "mix_kept", "_mix_topic": "topic", "lang_pred": "mine", "known": "7", "component_id": "8", "_drop_doc_id": "9", "text_sha256": "0"}


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
    more = {c: F.lit(v) for c, v in CLASHING.items()}
    for start in (docs.withColumns(more), empty.withColumns(more)):
        now, columns = start, start.columns
        for name, stage in corpus_pipeline.STAGES:
            before = now.count()
            out = f"{tmp_path}/{before}-{name}-{start is docs}-{len(list(tmp_path.iterdir()))}"
            stage(spark, now, "").write.parquet(out)
            now = spark.read.parquet(out)
            if name != "packing":
                assert now.columns == columns and now.count() <= before
                # Clashing columns keep their values.
                assert now.where("score <> 0.5 OR hash <> 'h' OR " + " OR ".join(f"{c} <> '{v}'" for c, v in CLASHING.items())).isEmpty()
            if name == "exact_dedup":
                assert now.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).distinct().count() == now.count()


def test_near_copies_without_an_id_of_their_own(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:-1] + [f"x{k}"])
    rows = [(None, near(1)), (None, near(2)), (None, "alone"), (None, None), (None, ""), (3, "other text of some length here"), (3, near(4)), (3, near(4)), (3, near(5))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    texts = [r["text"] for r in out]
    assert len(out) == 5 and sum(t in {near(k) for k in (1, 2, 4, 5)} for t in texts) == 1 and {None, "", "alone", "other text of some length here"} <= set(texts)
    assert [r["doc_id"] for r in out if r["text"] in (near(4), near(5))] == [3]


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    import re

    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by_id = {r[0]: r for r in rows}
    known = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert not known & {0, 1, 2} and {i for i, r in by_id.items() if len((r[1] or "").split()) > 20 and i is not None} <= known
    left = [by_id[i] for i in sorted((i for i in known), key=lambda i: (i is None, i))]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    left = list({norm(r[1]): r for r in reversed(left)}.values())[::-1]

    def shingles(text):
        words = text.encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(r[1]) for r in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    left = [r for i, r in enumerate(left) if i == min(k for k in range(len(left)) if group[k] == group[i])]
    probability, topic = brute_mix(left, 0.8)
    draw = lambda i: int(hashlib.sha256(f"mix:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    kept = {r[0] for r in left if draw(r[0]) < probability[r[3], r[2], topic(r[1])]}
    library = Tokenizer.from_file(default_tokenizer_path())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept
    length = collections.Counter()
    for r in out:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(library.encode(by_id[i][1], add_special_tokens=False).ids) + 1 for i in kept}
