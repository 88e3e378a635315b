"""Problem 8: evaluation texts in training text, by one Aho-Corasick automaton.

Texts are sequences of normalised words. A passage of ``words`` consecutive words of an
item holds at least one of the item's blocks of ``words // 2`` words, cut one behind the
other, whole. The automaton holds those blocks, so it has at most one state for each word
of the evaluation set, whatever the corpus. Each text is scanned once; each hit grows left
and right along the item as far as the words agree, and passages that are long enough map
back to the text's original character offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.runtime import skew_join, spread

WORDS = 12
#: Characters of evaluation text that one automaton takes: some 7 million states, 300 MB a
#: Python worker. Larger sets are matched by joins of word windows.
AUTOMATON_CHARS = 40_000_000
SCHEMA = "doc_id long, item_id long, start_char int, end_char int, n_words int"
_WORD = re.compile(r"[A-Za-z0-9]+")
_built: dict = {}


def _automaton(items: list[tuple[int, str]], words: int):
    """Word numbers, the items' word sequences, and the automaton over their blocks with
    the places (item's index, first word) of each."""
    import ahocorasick

    numbers: dict[str, int] = {}
    seqs = [(item, [numbers.setdefault(w.lower(), len(numbers) + 1) for w in _WORD.findall(text)]) for item, text in items]
    size = max(1, words // 2)
    places: dict[tuple, list] = {}
    for k, (_, ids) in enumerate(seqs):
        if len(ids) >= words:
            for i in range(0, len(ids) - size + 1, size):
                places.setdefault(tuple(ids[i : i + size]), []).append((k, i))
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, value in places.items():
        auto.add_word(key, value)
    if places:
        auto.make_automaton()
    return numbers, seqs, auto if places else None, size


def _passages(seq: tuple, seqs: list, auto, size: int, words: int) -> list[tuple[int, int, int]]:
    """Distinct (item, first, last) word ranges of a text that lie in an item, each as
    long as it can be."""
    found: set[tuple[int, int, int]] = set()
    #: per item and diagonal, how far the last passage reaches
    done: dict[tuple[int, int], int] = {}
    n = len(seq)
    for end, hits in auto.iter(seq):
        start = end - size + 1
        for k, i in hits:
            if done.get((k, start - i), -1) >= end:
                continue
            ids = seqs[k][1]
            a, x = start, i
            while a and x and seq[a - 1] == ids[x - 1]:
                a, x = a - 1, x - 1
            b, y = end, i + size - 1
            while b + 1 < n and y + 1 < len(ids) and seq[b + 1] == ids[y + 1]:
                b, y = b + 1, y + 1
            done[k, start - i] = b
            if b - a + 1 >= words:
                found.add((seqs[k][0], a, b))
    return sorted(found)


def _scanner(shared, words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        if (key, words) not in _built:
            _built.clear()
            _built[key, words] = _automaton(items, words)
        numbers, seqs, auto, size = _built[key, words]
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or auto is None:
                    continue
                at = [m.span() for m in _WORD.finditer(text)]
                if len(at) < words:
                    continue
                seq = tuple(numbers.get(text[s:e].lower(), 0) for s, e in at)
                out += [(doc, item, at[x][0], at[y][1], y - x + 1) for item, x, y in _passages(seq, seqs, auto, size, words)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["doc_id", "item_id", "start_char", "end_char", "n_words"])

    return scan


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, item_id, first word, last word) to passages with character offsets."""
    for b in batches:
        out, last, at = [], None, []
        for doc, text, item, x, y in zip(*(c.to_pylist() for c in b.columns)):
            if last != (doc, text):
                last, at = (doc, text), [m.span() for m in _WORD.finditer(text)]
            out.append((doc, item, at[x][0], at[y][1], y - x + 1))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["doc_id", "item_id", "start_char", "end_char", "n_words"])


def _windows(texts: DataFrame, words: int) -> DataFrame:
    """(key..., at, g): fingerprints of all runs of ``words`` words, ``at`` from 0."""
    w = texts.withColumn("w", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0), lambda x: F.xxhash64(F.lower(x)))).drop("text").filter(F.size("w") >= words)
    w = w.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - words)))
    return w.withColumn("g", F.sha2(F.slice("w", F.col("at") + 1, F.lit(words)).cast("string"), 256)).drop("w")


def joined_passages(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """What ``passages`` gives, for evaluation sets that no automaton can hold: windows of
    words are joined by fingerprint, and windows on one diagonal become passages."""
    docs = documents.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    own = _windows(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct().withColumn("it", F.xxhash64("item_id", "text")), words)
    own = own.withColumnRenamed("at", "i")
    theirs = _windows(docs.drop("doc_id"), words)
    hit = theirs.join(own.select("g").distinct(), "g", "left_semi")
    counts = hit.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    hit = skew_join(hit, counts.join(own.groupBy("g").agg(F.collect_set(F.struct("item_id", "it", "i")).alias("places")), "g"), ["g"])
    hit = hit.select("row", F.col("at"), F.explode("places").alias("p")).select("row", "at", "p.item_id", "p.it", (F.col("at") - F.col("p.i")).alias("diagonal")).distinct()
    w = Window.partitionBy("row", "it", "diagonal").orderBy("at")
    runs = hit.withColumn("run", F.col("at") - F.row_number().over(w)).groupBy("row", "item_id", "it", "diagonal", "run").agg(F.min("at").alias("x"), (F.max("at") + words - 1).cast("int").alias("y"))
    runs = runs.select("row", "item_id", "x", "y").distinct()
    return runs.join(docs, "row").select("doc_id", "text", "item_id", "x", "y").mapInArrow(_offsets, SCHEMA)


def passages(documents: DataFrame, items: DataFrame, words: int = WORDS, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``(doc_id, item_id, start_char, end_char, n_words)``: maximal passages of at least
    ``words`` consecutive words (runs of ASCII letters and digits, case ignored) that a
    document shares with an item; offsets count characters of the original text from 0.

    Null or short texts and items give nothing; an item repeated in several rows gives its
    passage under each id; a passage found twice in a document comes out twice, one that
    stands twice in the item once. The items are read to the driver only if all of them
    together have at most ``automaton_chars`` characters; the documents never are."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    size = own.agg(F.sum(F.length("text") + 16).cast("long")).first()[0] or 0
    if size > automaton_chars:
        return joined_passages(docs, own, words)
    rows = sorted(map(tuple, own.collect()), key=lambda r: (r[0] is None, r))
    shared = spark.sparkContext.broadcast((hash(tuple(rows)), rows))
    return spread(docs).mapInArrow(_scanner(shared, words), SCHEMA)


def leaked(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, item_id)`` pairs, each once."""
    return passages(documents, items, words).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """``(item_id, task, n_documents, longest_words)`` for every item, 0 where it did not leak."""
    p = passages(documents, items, words).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"), F.max("n_words").alias("w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return items.select("item_id", "task").distinct().join(p, "item_id", "left").select("item_id", "task", zero("n").cast("long").alias("n_documents"), zero("w").cast("int").alias("longest_words"))
