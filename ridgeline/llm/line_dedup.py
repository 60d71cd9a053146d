"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text is cut into lines: at line ends and after the end of a sentence. Every window of consecutive lines that holds
``min_words`` words selects its least line hash as a fingerprint, so a run of lines with that many words that two
places share has a fingerprint in both. Positions of fingerprints are joined by hash; where one occurs twice, the match is
extended both ways line by line: every window around the position, from its first line on to each last line that it can
have, is compared by content. A window whose content occurred before - in a document with a smaller id, or further up in
the same one - belongs to a repeated run, and the run, which is the union of such windows, is deleted. Of each run the
first occurrence stays.

Order of documents: id (null first), then the text's hash. Rows with the same id and text count as one document and
get the same result. Defined results: a null text stays null, an empty one empty; blank lines hold no words, a match
looks past them, and those inside a deleted run go with it; lines are equal if they agree but for white space around
them; lines that repeat one another inside a document keep their first; a text of fewer than ``min_words`` words is
left alone; a text may become empty; other columns are ignored; an empty table gives an empty table.

Work is linear. A document is one row with arrays of its lines' hashes and words, and windows and their minima are found
inside it; only fingerprints are shuffled, and of matched documents the windows around them. First places are aggregated
before they are shuffled, and a content that very many windows have is joined by a bounded broadcast (``join_hot``), so a
passage that a third of all documents share costs its own rows and nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import join_hot, join_small, materialize, pick

#: Words that a run needs to be deleted; shorter repeats (headings, licence lines) stay.
MIN_WORDS = 30
#: Lines that hold a window in nearly every text.
COMMON = 8
#: A line: up to a line end, or up to white space after the end of a sentence, with what ends it.
LINE = r"(?s)[^\n]*?(?:\n|[.!?][ \t]+\n?|\z)"
MARK = "\x01"
#: Texts without any of these have lone spaces and line ends only; they are cut at literals, which gives the same lines.
UNEVEN = ("  ", " \n", "\t", "\x0b", "\x0c", "\r", MARK)


def literal(x: str) -> str:
    return "'" + x.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def is_even(text: str) -> str:
    """SQL: whether the text can be cut at literals."""
    return "not (" + " or ".join(f"contains(`{text}`, {literal(x)})" for x in UNEVEN) + ")"


def lines_of(text: str) -> str:
    """SQL: the array of a text's lines."""
    marked = f"`{text}`"
    for end in (". ", "! ", "? ", "\n"):
        marked = f"replace({marked}, {literal(end)}, {literal(end + MARK)})"
    return f"if({is_even(text)}, split({marked}, {literal(MARK)}), regexp_extract_all(`{text}`, r'{LINE}', 0))"


def same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def line_arrays(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, pos, h, n, ends, at): arrays over the lines with words of each text.

    pos: place among all lines; h: hash; n: words; ends: last line of the window that starts at each (their number where
    too few words follow); at: place of that window's least hash, the leftmost (-1 where there is no window).
    """
    plain = "text"
    for end, kept in ((". ", "."), ("! ", "!"), ("? ", "?"), ("\n", "")):  # as lines_of() does, without what is trimmed anyway
        plain = f"replace({plain}, {literal(end)}, {literal(kept + MARK)})"
    even = F.transform(F.expr(f"split({plain}, {literal(MARK)})"), lambda x: F.trim(x))
    odd = F.transform(F.expr(f"regexp_extract_all(text, r'{LINE}', 0)"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    cut = docs.where("text is not null").select("id", "th", "text", F.expr(is_even("text")).alias("even"))
    cut = cut.select("id", "th", "even", F.when(F.col("even"), even).otherwise(odd).alias("all"))
    cut = cut.select("id", "th", "even", "all", F.filter("all", lambda x: x != "").alias("cut"))
    lone = F.transform("cut", lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    counted = F.transform("cut", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    # (where no line is blank, places are plain numbers)
    placed = "if(size(cut) = size(all), transform(cut, (x, i) -> i), filter(transform(all, (x, i) -> if(x = '', -1, i)), i -> i >= 0))"
    lines = cut.select("id", "th", F.expr(placed).alias("pos"), F.transform("cut", lambda x: F.xxhash64(x)).alias("h"), F.when(F.col("even"), lone).otherwise(counted).alias("n"))
    # words of the next 2, 4 and so on lines, no more than would fill a window; past the end every line fills one
    wide, past = 1, min_words
    lines = lines.withColumn("_1", F.transform("n", lambda w: F.least(w.cast("int"), F.lit(past))))
    while wide < min_words:
        pairs = f"transform(_{wide}, (w, i) -> if(w >= {past}, w, w + coalesce(get(_{wide}, i + {wide}), {past})))"
        if wide >= COMMON:  # only texts with windows of so many lines
            pairs = f"if(exists(_{wide}, w -> w < {past}), {pairs}, _{wide})"
        lines = lines.withColumn(f"_{2 * wide}", F.expr(pairs))
        wide *= 2
    # lines of a window but its last: as many as leave it short of words, found by halving; so far: lines * 2 to the 32 + words
    def reach(most: int) -> str:
        out = "0L"
        while most:
            step = f"coalesce(get(_{most}, i + cast(shiftright(a, 32) as int)), {past})"
            out = f"transform(array({out}), a -> if((a & 4294967295) + {step} < {past}, a + {most << 32}L + {step}, a))[0]"
            most //= 2
        return f"transform(n, (x, i) -> cast(least(i + shiftright({out}, 32), size(n)) as int))"

    common = f"if(exists(_{COMMON}, w -> w < {past}), {reach(wide // 2)}, {reach(COMMON // 2)})" if wide > COMMON else reach(wide // 2)
    lines = lines.select("id", "th", "pos", "h", "n", F.expr(common).alias("ends"))
    # a hash's upper half and the line's place in one number, so that the least has its place with it
    lines = lines.withColumn("_p", F.expr("transform(h, (x, i) -> shiftleft(shiftright(x, 32), 32) + i)"))
    at = "transform(ends, (e, i) -> if(e < size(n), cast(array_min(slice(_p, i + 1, e - i + 1)) & 4294967295 as int), -1))"
    return lines.select("id", "th", "pos", "h", "n", "ends", F.expr(at).alias("at"))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(id, th, runs array<struct<a, b>>) of line_arrays() (materialised): first and last line of each run to delete, in order."""
    # fingerprints, with the first and the last window start that selects each
    first = "filter(transform(at, (a, i) -> if(a >= 0 and (i = 0 or at[i - 1] <> a), i, -1)), i -> i >= 0)"
    chosen = lines.select("id", "th", "h", "at", F.expr(first).alias("lo"), F.expr(first.replace("(i = 0 or at[i - 1] <> a)", "(i = size(at) - 1 or at[i + 1] <> a)")).alias("hi"))
    picked = chosen.select("id", "th", F.expr("inline(transform(lo, (x, k) -> struct(h[at[x]] as f, x as lo, hi[k] as hi)))"))
    place = F.xxhash64("id", "th", "lo")
    shared = picked.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("k")).where("a <> b")
    shared = materialize(shared.select("f", "k"), "shared")
    matched = join_hot(picked, shared, ["f"], "k").groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("met"))
    matched = materialize(matched, "matched", shared)

    # windows around matched positions: from each start, with each last line up to where the next start's window ends
    near = lines.select("id", "th", "h", "ends").alias("l").join(matched.alias("m").hint("merge"), same_document("l", "m")).select("l.id", "l.th", "h", "ends", "met")
    lasts = "sequence(ends[i], greatest(ends[i], coalesce(get(ends, i + 1), size(ends)) - 1))"
    windows = F.expr(f"flatten(transform(flatten(transform(met, m -> sequence(m.lo, m.hi))), i -> transform({lasts}, e -> struct(i as `from`, e as `to`))))")
    inside = "slice(h, w.`from` + 1, w.`to` - w.`from` + 1)"
    windows = near.select("id", "th", "h", windows.alias("windows"))
    windows = windows.select("id", "th", F.expr(f"inline(transform(windows, w -> struct(xxhash64({inside}) as c1, xxhash64(1, {inside}) as c2, w.`from` as `from`, w.`to` as `to`)))"))
    windows = materialize(windows, "windows", matched)
    start = F.struct("id", "th", "from")
    first = windows.groupBy("c1", "c2").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("k")).where("first <> last")
    first = materialize(first.select("c1", "c2", "first", "k"), "first")
    repeats = join_hot(windows, first, ["c1", "c2"], "k").where("struct(id, th, `from`) > first").select("id", "th", "from", "to")

    # runs: windows that overlap or adjoin
    doc = Window.partitionBy("id", "th").orderBy("from", "to")
    gap = F.col("from") > F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1)) + 1
    runs = repeats.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("id", "th", "run").agg(F.min("from").alias("a"), F.max("to").alias("b"))
    runs = runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    return materialize(runs, "repeats", windows, first)


def runs_by_document(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, runs array<struct<first_line, last_line>>, removed_lines, removed_words) of the documents with repeated runs."""
    docs = pick(df, id=id_col, text=text_col).withColumn("th", F.xxhash64("text"))
    lines = materialize(line_arrays(docs, min_words), "lines")
    runs = repeated_runs(lines)
    found = lines.select("id", "th", "pos", "n").alias("l").join(runs.alias("r").hint("merge"), same_document("l", "r")).select("l.id", "l.th", "pos", "n", "runs")
    found = found.select(
        "id", "th", F.expr("transform(runs, r -> struct(pos[r.a] as first_line, pos[r.b] as last_line))").alias("runs"),
        F.expr("aggregate(runs, 0L, (s, r) -> s + r.b - r.a + 1)").alias("removed_lines"),
        F.expr("aggregate(runs, 0L, (s, r) -> s + aggregate(slice(n, r.a + 1, r.b - r.a + 1), 0L, (t, w) -> t + w))").alias("removed_words"),
    )
    return materialize(found.dropDuplicates(["id", "th"]), "runs", lines, runs)


def without_runs(text: str = "text", runs: str = "runs") -> Column:
    """The text in column ``text`` without the lines of ``runs`` (null: all lines stay)."""
    start = f"if(i = 0, 0, `{runs}`[i - 1].last_line + 1)"
    length = f"if(i = size(`{runs}`), size(l), `{runs}`[i].first_line) - {start}"
    left = f"transform(array({lines_of(text)}), l -> concat_ws('', flatten(transform(sequence(0, size(`{runs}`)), i -> slice(l, {start} + 1, {length})))))[0]"
    return F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.expr(left))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, removed_runs array<struct<first_line, last_line>>, removed_lines, removed_words): texts without repeated runs."""
    d = pick(df, id=id_col, text=text_col).alias("d")
    g = runs_by_document(df, min_words, id_col, text_col).alias("g")
    joined = join_small(d, g, F.col("d.id").eqNullSafe(F.col("g.id")) & F.xxhash64("d.text").eqNullSafe(F.col("g.th")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("d.id").alias(id_col), without_runs().alias(text_col), F.col("runs").alias("removed_runs"),
        F.coalesce("removed_lines", zero).alias("removed_lines"), F.coalesce("removed_words", zero).alias("removed_words"),
    )
