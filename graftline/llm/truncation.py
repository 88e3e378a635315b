"""Problem 10: text cut off by field limits or in transfer.

For every source, the discrete hazard of each length (texts that end there among those
that get there) comes from window functions over the table of lengths. A hazard is tested
against the hazard of its neighbouring lengths, and the Benjamini-Hochberg procedure
keeps the false-discovery rate. At a significant length every ending that is not clearly
complete counts as cut; elsewhere only an ending that stops inside a word, a sentence, a
code line or an open block does.

Whether a last word is a fragment is learnt from the corpus: it is one if it is rare as a
word of its own against the longer words that it begins. Texts are read twice, for their
endings and for their words; what is known of the endings is narrow and written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.runtime import bounded, cut, skew_join, spread

#: Lengths on either side that a hazard is compared with, widely and closely, and the
#: false-discovery rate.
NEIGHBOURS, CLOSE, FDR = 60, 5, 0.001
#: A word is no fragment if it has at least this share of the texts of the longer words
#: that it begins: as a word inside texts, or as the end of texts no limit has cut.
INSIDE, FINAL = 0.001, 0.1
BLANK = " \t\n\x0b\f\r\u00a0"
#: Words after which a line goes on.
OPEN_WORDS = "a an and as at because but by de der die du el for from if into its la le les los of or our su than the their un una und une when which while who with y your".split()
CLOSINGS = r"(many thanks|thanks( (in advance|again|a lot))?|thank you|thx|ta|cheers|hth|hope (this|that) helps|regards|best|(best|kind|warm) (regards|wishes)|sincerely|merci|danke|gracias|saludos|gruß|vg|mfg|br)"
SIGN_OFF = rf"(?i)^\W*{CLOSINGS}\b[^.!?]{{0,60}}$"
SIGN_WORD = rf"(?i)^\W*{CLOSINGS}\W*$"
MARK = r"(?i)(\[\s*(\.{2,}|…|more|cut|snip|truncated|continued)\s*\]|\(\s*(more|cut|truncated|continued)\s*\)|<(cut|truncated)>|read more\W*|�)$"


def clean_source(c: str = "source") -> Column:
    """One spelling of each source: lower case, no outer blanks, ``_`` for ``-`` or blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", "")), r"[-\s]+", "_")


def length_hazards(lengths: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(source, n, ends, at_risk, hazard, near, expected, p)`` from rows ``(source, n)``.

    ``hazard`` is ends over at_risk, ``near`` the hazard of the neighbouring lengths: their
    ends over all that were at risk there, length by length, the close or the wide ones',
    whichever is greater: a limit is one length, while a kind of text of about one size
    raises the hazards of many lengths. ``expected`` is the number of ends at this length
    under that hazard; ``p`` is the Chernoff bound of the Poisson upper tail, so never too
    small."""
    c = lengths.groupBy("source", "n").agg(F.count(F.lit(1)).alias("ends"))
    up = Window.partitionBy("source").orderBy("n")
    c = c.withColumn("at_risk", F.sum("ends").over(Window.partitionBy("source").orderBy(F.col("n").desc())))
    #: lengths at which no text ends had as many at risk as the next one that some text has
    c = c.withColumn("gap", F.col("n") - F.coalesce(F.lag("n").over(up), F.lit(0)))

    def around(width: int) -> Column:
        near = up.rangeBetween(-width, width)
        exposed = F.sum(F.col("at_risk") * F.least("gap", F.lit(width))).over(near) - F.col("at_risk")
        return (F.sum("ends").over(near) - F.col("ends") + 1) / F.greatest(exposed, F.lit(1))

    c = c.withColumn("near", F.greatest(around(neighbours), around(CLOSE)))
    mu = F.col("at_risk") * F.col("near")
    ratio = F.col("ends") / mu
    p = F.when(ratio <= 1, 1.0).otherwise(F.exp(-(F.col("ends") * F.log(ratio) - F.col("ends") + mu)))
    return c.drop("gap").withColumn("hazard", F.col("ends") / F.col("at_risk")).withColumn("expected", mu).withColumn("p", p)


def significant_lengths(hazards: DataFrame, fdr: float = FDR, tests: int | None = None) -> DataFrame:
    """``(source, n)`` whose hazard stands out at the false-discovery rate ``fdr``.

    A p-value above ``fdr`` can never be rejected, so only the others are kept. The
    Benjamini-Hochberg bound is the greatest t with t = fdr * #(p <= t) / tests, reached
    from above by counting, without ranking all p-values in one task."""
    m = max(hazards.count() if tests is None else tests, 1)
    low = cut(hazards.filter(F.col("p") <= fdr).select("source", "n", "p"))
    k, t = None, fdr
    while (now := low.filter(F.col("p") <= t).count()) != k:
        k, t = now, fdr * now / m
    return low.filter(F.col("p") <= t).select("source", "n")


def _last_line(body: str) -> Column:
    return F.substring_index(F.substring_index(body, "\n", -1), "\r", -1)


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n, and what the ending looks like) without any Python. Patterns
    look at the last line only, but for fences and tags, which are counted in the whole
    text where it holds any."""
    d = documents.select("doc_id", clean_source().alias("source"), F.col("text").alias("t"), F.length("text").alias("n")).filter(F.col("t").isNotNull())
    d = d.withColumn("body", F.rtrim("t", F.lit(BLANK)))
    d = d.filter(F.length("body") > 0)
    d = d.withColumn("line", F.regexp_replace(_last_line("body"), r"^(\s?>)+ ?", ""))
    has = lambda x: F.contains("body", F.lit(x))
    no = F.lit(False)
    fence = F.when(has("```") | has("~~~"), F.size(F.regexp_extract_all("body", F.lit(r"(?m)^[ \t>]*(```|~~~)"), 1)) % 2 == 1).otherwise(no)
    count = lambda p: F.size(F.regexp_extract_all("body", F.lit(p), 0))
    block = F.when(has("<"), (count(r"(?i)<pre\b") > count(r"(?i)</pre>")) | (count(r"(?i)<code\b") > count(r"(?i)</code>"))).otherwise(no)
    line = F.col("line")
    tail = F.col("t").substr(F.length("body"), F.col("n"))
    words = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    code = line.rlike(r"^(\t| {4})\s*\S")
    #: patterns that can only match a few last characters are tried on those
    back = lambda n: F.right(line, F.lit(n))
    open_word = back(max(map(len, OPEN_WORDS)) + 1).rlike(r"(?i)(^|[^\p{L}\p{N}_./-])(" + "|".join(OPEN_WORDS) + r")$")
    ends_open = tail.rlike(r"^[^.!?:;)\]>}`\s][ \t\u00a0]+\z") | back(1).rlike(r"[,(\[{=+&|\\/<_@#$%]") | back(2).rlike(r"[^\w\s]-$|\s-$") | open_word
    number = lambda c: F.length(line) - F.length(F.translate(line, c, ""))
    unbalanced = (number("[") > number("]")) | (number("(") > number(")")) | (code & (number("{") > number("}")))
    mark = F.when(back(1).isin("]", ")", ">", "\ufffd"), line.rlike(MARK)).otherwise(F.contains(F.lower(line), F.lit("read more")) & line.rlike(MARK))
    dots = F.endswith(line, F.lit("...")) | F.endswith(line, F.lit("…"))
    link = (F.contains(line, F.lit("://")) | F.contains(line, F.lit("]("))) & line.rlike(r"https?://\S+$|\]\([^()\s]+\)$")
    return d.select(
        "doc_id", "source", "n", F.octet_length("t").alias("n_bytes"),
        (fence | block).alias("inside"),
        mark.alias("mark"),
        dots.alias("dots"),
        (line.rlike(r"[.!?。！？؟][\"'”’»)\]*_`]*$") | line.rlike(r"(?i)</[a-z][a-z0-9]*>$|<(br|hr|img)\b[^<>]*/?>$") | line.rlike(r"^\s*(```|~~~|[-=*_]{3,})$|\|\s*$")).alias("closed"),
        link.alias("link"),
        line.rlike(r"^\s*([-*+•]|\d{1,3}[.)])\s+\S").alias("item"),
        (line.rlike(SIGN_OFF) | line.rlike(r"^--\s*\S.{0,60}$") | line.rlike(r"^\s*[-–—]\s?\p{Lu}[\p{L} .]{0,40}$")).alias("sign"),
        line.rlike(SIGN_WORD).alias("sign_word"),
        code.alias("code"),
        (code & (line.rlike(r"[;)\]}\"'`]$|=\S+$|^\s*(return|break|continue|pass|else|end|fi|done|raise|import)\b.*$") & ~line.rlike(r"(?i)^\s*(select|insert|update|delete)\b.*[^;]$"))).alias("code_done"),
        (words <= 6).alias("short"),
        line.rlike(r"^\s*[\p{Ll}+\d\-]").alias("low"),
        (F.instr("body", "\n") == 0).alias("single"),
        (words <= 3).alias("tiny"),
        (ends_open | unbalanced).alias("open"),
        (F.endswith(line, F.lit(".")) & line.rlike(r"\p{Lu}[\p{L}]*\d+\.$|\s\d+\.$")).alias("number_dot"),
        F.regexp_extract(F.regexp_replace(line, r"(\.{3}|…)$", ""), r"(?:^|[^\p{L}\p{N}_])(\p{Ll}+)$", 1).alias("word"),
        F.reverse(F.regexp_extract(F.reverse("t"), r"\A\W*(\p{Ll}+)", 1)).alias("final"),
        (F.size(F.split(F.trim("t"), r"\s+", 7)) <= 6).alias("brief"),
    )


def inner_words(documents: DataFrame) -> DataFrame:
    """``(word, df)``: the texts that hold each lower-case word before their last one, not
    counting what a source put in place of a missing rest."""
    d = documents.select(F.rtrim("text", F.lit(BLANK)).alias("body")).filter(F.length("body") > 0).withColumn("line", _last_line("body"))
    head = F.left("body", F.length("body") - F.length("line"))
    d = d.select(F.rtrim(F.concat(head, F.regexp_replace("line", MARK + r"|(\.{3}|…)$", "")), F.lit(BLANK)).alias("s"))
    before = F.left("s", F.length("s") - F.length(F.regexp_extract(F.reverse("s"), r"\A(\S+)", 1)))
    w = d.select(F.explode(F.array_distinct(F.split(before, r"[^\p{L}\p{N}]+"))).alias("word")).filter(F.col("word").rlike(r"^\p{Ll}+$"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def known_words(words: DataFrame, inner: DataFrame, final: DataFrame) -> DataFrame:
    """``words`` ``(word, n)`` with ``known``: whether a word is one of its own and not just
    the beginning of longer ones. ``inner`` and ``final`` are ``(word, df)``: texts with
    the word inside, and whole texts that end with it. Every figure is a share, so that a
    corpus of any size judges alike."""
    hint, _ = bounded(words.select("word"), 500_000)
    #: each longer word counts for all its beginnings that some text ends with
    longer = inner.filter(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.left(F.col("word"), i))).alias("word"), "df")
    longer = longer.join(hint, "word", "left_semi").groupBy("word").agg(F.sum("df").alias("longer"))
    w = words.join(inner.join(hint, "word", "left_semi").withColumnRenamed("df", "inside"), "word", "left").join(longer, "word", "left").join(final.withColumnRenamed("df", "final"), "word", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = ((zero("inside") > 0) & (zero("inside") >= INSIDE * zero("longer"))) | ((zero("final") > 1) & (zero("final") >= FINAL * zero("longer")))
    return w.select("word", "n", known.alias("known"))


def judged(documents: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """``(doc_id, source, n, at_limit, truncated)`` for every text with visible characters;
    limits are looked for in characters and in bytes.

    Null and blank texts are not judged. A null source takes part under its own name and
    also counts as at a limit where any source has one. Equal texts are judged alike; a
    doc_id in several rows is judged per row."""
    texts = spread(documents.select("doc_id", "source", "text"))
    e = cut(endings(texts).withColumn("source", F.coalesce("source", F.lit(""))))
    #: fields are limited in characters or in bytes
    unit = F.explode(F.array(F.struct(F.lit("characters").alias("unit"), "n"), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("n"))))
    both = e.select("source", unit.alias("u")).select(F.concat("source", F.lit("\0"), "u.unit").alias("source"), "u.n")
    sig = cut(significant_lengths(cut(length_hazards(both, neighbours)), fdr))
    sig = sig.select(F.substring_index("source", "\0", 1).alias("source"), F.substring_index("source", "\0", -1).alias("unit"), "n")
    sig = sig.unionByName(sig.withColumn("source", F.lit(""))).distinct().withColumn("at_limit", F.lit(True))
    chars, _ = bounded(sig.filter("unit = 'characters'").drop("unit"))
    octets, _ = bounded(sig.filter("unit = 'bytes'").select("source", F.col("n").alias("n_bytes"), F.col("at_limit").alias("at_bytes")))
    e = e.join(chars, ["source", "n"], "left").join(octets, ["source", "n_bytes"], "left")
    final = e.filter((F.col("at_limit").isNull() | F.col("brief")) & (F.col("final") != "")).groupBy(F.col("final").alias("word")).agg(F.count(F.lit(1)).alias("df"))
    e = e.withColumn("at_limit", F.col("at_limit").isNotNull() | F.col("at_bytes").isNotNull()).drop("at_bytes", "final", "brief")
    worded = e.filter("word <> ''")
    words = known_words(cut(worded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))), cut(inner_words(documents)), final)
    #: texts without a last word, and those with a frequent one, meet in no task
    words = cut(words).withColumnRenamed("n", "_n")
    e = skew_join(worded, words, ["word"], "_n").drop("_n").unionByName(e.filter("word = ''").withColumn("known", F.lit(None).cast("boolean")))
    at = F.coalesce("at_limit", F.lit(False))
    unknown = (F.col("word") != "") & ~F.col("known") & ~(F.col("single") & F.col("tiny")) & ~F.col("sign_word")
    whole = F.col("link") | F.col("item") | F.col("sign") | (F.col("short") & F.col("low") & ~F.col("code")) | (F.col("single") & F.col("tiny")) | F.col("code_done")
    #: a cut that the ending itself shows
    shows = F.when(F.col("inside") | F.col("mark"), True).when(F.col("dots"), unknown | F.col("open")).when(F.col("closed"), False).when(whole, F.col("open") | (unknown & ~F.col("link") & ~F.col("code"))).otherwise(True)
    #: at a limit, only an ending that is clearly complete is let pass
    passes = (F.col("closed") & ~F.col("dots") & ~F.col("number_dot")) | ((F.col("sign") | (F.col("single") & F.col("short") & F.col("low"))) & ~F.col("open") & ~unknown)
    truncated = F.when(at, shows | ~passes).otherwise(shows)
    return e.select("doc_id", F.when(F.col("source") != "", F.col("source")).alias("source"), "n", at.alias("at_limit"), truncated.alias("truncated"))


def source_rates(verdicts: DataFrame) -> DataFrame:
    """``(source, n_documents, n_truncated, n_at_limit, rate)`` per source."""
    t = F.col("truncated").cast("long")
    return verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(t).alias("n_truncated"), F.sum(t * F.col("at_limit").cast("long")).alias("n_at_limit"), F.round(F.avg(t), 6).alias("rate"))
