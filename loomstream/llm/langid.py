"""Language identification by words, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, release, select_as, written

WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores or counts a worker keeps; beyond it scores are forgotten and counts are sent on.
KEPT_WORDS = 200_000


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class WordScores:
    """Log frequencies of words (the first table) and of n-grams (by n), and the rows of scores of the words met so far.

    A table is the rows' numbers by name and a row of one score a language each.  A word's row has a score a language,
    1 if the word has a letter, and then how well it is known: 1 as a word, else the share of its n-grams of the
    longest order that the model knows.  floor is the share of a text's words that must be known for its language to
    be recognised.
    """

    floor = 0.0

    def __init__(self, langs: list[str], tables: list[tuple[dict[str, int], np.ndarray]], backoff: float) -> None:
        self.langs, self.tables, self.backoff = langs, tables, backoff
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 2))

    def meet(self, new: list[str]) -> None:
        """Score words that have no row yet, all together."""
        begin, end = len(self.row), len(self.row) + len(new)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.row.update(zip(new, range(begin, end), strict=True))
        scored = self.table[begin:end]
        left = [i for i, w in enumerate(new) if any(map(str.isalpha, w))]
        scored[left, -2] = 1
        index, values = self.tables[0]
        known = [i for i in left if new[i] in index]
        scored[known, -1] = 1
        scored[known, :-2] = values[[index[new[i]] for i in known]]
        left = [i for i in left if new[i] not in index]
        for n in range(len(self.tables) - 1, 0, -1):
            index, values = self.tables[n]
            at, done, sizes, rest = [], [], [], []
            for i in left:
                found = [k for g in grams(new[i], n) if (k := index.get(g)) is not None]
                if n == len(self.tables) - 1:
                    scored[i, -1] = len(found) / max(1, len(new[i]) + 3 - n)
                if found:
                    at += found
                    done.append(i)
                    sizes.append(len(found))
                else:
                    rest.append(i)
            if done:
                each = np.array(sizes)
                scored[done, :-2] = np.add.reduceat(values[at], np.cumsum(each) - each) / each[:, None] + (len(self.tables) - n) * self.backoff
            left = rest

    def rows(self, words: list[str]) -> np.ndarray:
        out = list(map(self.row.get, words))
        if None in out:
            self.meet(list(dict.fromkeys(w for w, at in zip(words, out, strict=True) if at is None)))
            out = list(map(self.row.get, words))
        return self.table[out]


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, c of all rows' words that have a letter; a task's table is sent on when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> pa.RecordBatch:
            found = [(lang, w, c) for lang, of_lang in words.items() for w, c in of_lang.items() if any(map(str.isalpha, w))]
            words.clear()
            langs, names, counts = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "c"])

        make_room()
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.as_py().lower()))
                if sum(map(len, words.values())) > KEPT_WORDS:
                    yield full()
        yield full()
        release()

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def _gram_counts(words: DataFrame, n: int) -> DataFrame:
    """lang, n, gram, c: the n-grams of words, each word as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> pa.RecordBatch:
            found = [(lang, len(g), g, c) for lang, of_lang in counts.items() for g, c in of_lang.items()]
            counts.clear()
            langs, orders, keys, each = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(orders, pa.int32()), pa.array(keys, pa.string()), pa.array(each, pa.int64())], ["lang", "n", "gram", "c"])

        make_room()
        counts: dict[str, dict[str, int]] = {}
        for batch in batches:
            for k, (lang, w, c) in enumerate(zip(*(x.to_pylist() for x in batch.columns), strict=True)):
                of_lang = counts.setdefault(lang, {})
                padded = f" {w} "
                for m in range(1, n + 1):
                    for i in range(len(padded) - m + 1):
                        g = padded[i : i + m]
                        of_lang[g] = of_lang.get(g, 0) + c
                if (k % 100 == 0 or len(w) > 1000) and sum(map(len, counts.values())) > KEPT_WORDS:
                    yield full()
        yield full()
        release()

    return words.select("lang", "word", "c").mapInArrow(run, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def floor_of(scored: DataFrame, name: str = "known") -> float:
    """The floor by scored texts: half of what the least known hundredth of them has, from exact counts of all by steps
    of 1 / 10,000."""
    steps = scored.groupBy(F.floor(F.col(f"`{name}`") * 10_000).alias("step")).agg(F.count("*").alias("c")).collect()
    left = -(-sum(r["c"] for r in steps) // 100)
    for r in sorted(steps, key=lambda r: r["step"]):
        left -= r["c"]
        if left <= 0:
            return r["step"] / 20_000
    return 0.0


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n: int = 4, backoff: float = -0.5, least: int = 2, rare: float = 1e-6, check_rows: int = 0) -> WordScores | None:
    """A classifier fitted on all labelled rows; None when there are none.

    Words are counted over all rows, and n-grams over all words.  Every task is sent the model, so it has entries of
    its own only for words and n-grams seen at least `least` times and once in 1 / rare running words, which are 1 / rare
    words at most; a rarer word is scored through its n-grams, whose counts it is part of, and a rarer n-gram through
    shorter ones.  Rows without text or language teach nothing; repeated rows count as often as they are there.

    With `check_rows` the model's floor is fitted as well, on about so many of the rows, see floor_of.
    """
    rows = select_as(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")
    words = written(_word_counts(rows))
    bar = max(least, rare * (words.agg(F.sum("c")).first()[0] or 0))
    counted = words.select("lang", F.lit(0).alias("n"), F.col("word").alias("gram"), "c").unionByName(_gram_counts(words, n))
    # Single characters are few; they are what all else falls back to.
    enough = F.col("all") >= F.when(F.col("n") == 1, F.lit(float(least))).otherwise(F.lit(float(bar)))
    by_gram = counted.groupBy("n", "gram").agg(F.collect_list(F.struct("lang", "c")).alias("of"), F.sum("c").alias("all")).where(enough)
    table = by_gram.select("n", "gram", "of").toArrow()
    langs = sorted({x["lang"] for of in table["of"].to_pylist() for x in of})
    if not langs:
        return None
    place = {lang: i for i, lang in enumerate(langs)}
    of_order = np.array(table["n"])
    tables: list[tuple[dict[str, int], np.ndarray]] = []
    for m in range(n + 1):
        part = table.filter(pa.array(of_order == m))
        names = part["gram"].to_pylist()
        c = np.full((len(names), len(langs)), 0.1)
        for i, of in enumerate(part["of"].to_pylist()):
            for x in of:
                c[i, place[x["lang"]]] += x["c"]
        tables.append(({name: i for i, name in enumerate(names)}, np.log(c / c.sum(0))))
    model = WordScores(langs, tables, backoff)
    if check_rows:
        share = min(1, check_rows / rows.count())
        model.floor = floor_of(predict(rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language floor")), F.lit(1 << 30)) < int(share * (1 << 30))), model))
    return model


def predict(docs: DataFrame, model: WordScores | None, *, text_col: str = "text", names: Sequence[str] = ("lang_pred", "score", "known")) -> DataFrame:
    """docs' rows with lang_pred, score and known (both 0 to 1) behind their own columns, read from the text alone; names
    gives the three other names, and columns of docs that have them are replaced.

    A text scores for each language the sum over its words of the word's log frequency there; a word that the model
    does not know takes the mean of its known character n-grams of the longest order that has one, less a penalty for
    each order given up.  score is the posterior of the best language under equal priors; ties go to the language
    first in order.  known is the mean over its words of how well they are known.  lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learned.
    Whole texts are read, in a narrow map; repeated rows are scored alike; no rows give no rows.
    """
    kept = docs.drop(*names)
    own = kept.columns
    at = own.index(text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.langs, model.tables, model.backoff)) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        scores = WordScores(*shared.value) if shared else None
        for batch in batches:
            langs, values, shares = [], [], []
            for text in batch.column(at).to_pylist():
                words = WORD.findall(text.lower()) if text and scores else []
                if not words:
                    langs.append("und")
                    values.append(0.0)
                    shares.append(0.0)
                    continue
                total = np.zeros(len(scores.langs) + 2)
                for i in range(0, len(words), 50_000):
                    total += scores.rows(words[i : i + 50_000]).sum(0)
                    if len(scores.row) > KEPT_WORDS:
                        scores.clear()
                best = int(np.argmax(total[:-2])) if total[-2] else -1
                langs.append(scores.langs[best] if best >= 0 else "und")
                values.append(float(1 / np.exp(total[:-2] - total[best]).sum()) if best >= 0 else 0.0)
                shares.append(float(total[-1] / total[-2]) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(values, pa.float64()), pa.array(shares, pa.float64())], [*own, *names])
        scores = None
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` double")
