"""Operator 5: line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that are not blank. A run of lines qualifies if it has LINES lines, or LONG bytes in all. Every
qualifying run that also begins at an earlier place, in order of (doc_id, line), goes: of a repeated run the first stays, within
a document as across documents.

1. From each line on, the shortest qualifying run is a window; the least line hash in it is a fingerprint. Only these minima are stored,
   each with its neighbourhood of LINES - 1 lines to either side. Windows look at nothing outside, so a repeated run has its fingerprints
   wherever it stands: the guarantee of winnowing.
2. Fingerprints that occur once are done with. The positions of the others meet, and matches are extended both ways: to each qualifying
   run of up to LINES lines around the position that holds it. Equal runs have equal hashes (96 bits over all lines).
3. All but the first place of a run are marked; overlapping marks join to the whole repeated run, however long.

Counts and first places are combined before each shuffle, and positions meet repeated fingerprints in a join whose hot keys Spark may
split. Work is linear in the lines. Texts move only if a bounded filter can't rule out that they have marks.

Defined cases: null text stays null and has no lines; blank lines are never deleted and don't part a run; rows with the same doc_id and
text are one document; a null doc_id takes no part; an empty table gives no rows; a text of very many lines is linear work;
other columns, whatever their names, pass through ``dedup`` (n_chars, if there, is counted anew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import free, parted, quoted, stored

LINES, LONG = 3, 300
BLANK = " \t\r\x0b\x0c"


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) == ""


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, seq): place, two hashes and bytes of each line that is not blank. Stored, so that texts are parsed once."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    seq = F.transform(F.filter(lines, lambda x: ~blank(x["line"])), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("m"), F.octet_length(x["line"]).alias("n")))
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), seq.alias("seq"))
    return stored(rows.filter(F.size("seq") > 0), "line-sequences")


def qualifies(lines: list[Column], most: int, long: int) -> Column:
    return F.lit(True) if len(lines) >= most else sum((x["n"] for x in lines[1:]), lines[0]["n"]) >= long


def fingerprints(seq: DataFrame, most: int, long: int) -> DataFrame:
    """(doc_id, tag, print, p, near, q): each window's least line hash, its place in the sequence, the lines around and its place there."""

    def pick(i: Column) -> Column:
        x = [F.get("seq", i + k) for k in range(most)]
        out = F.lit(None).cast("int")
        for m in range(most, 0, -1):
            low = F.least(*[e["h"] for e in x[:m]]) if m > 1 else x[0]["h"]
            at = i
            for k in range(m - 1, 0, -1):
                at = F.when(x[k]["h"] == low, i + k).otherwise(at)
            at = F.when(x[0]["h"] == low, i).otherwise(at)
            out = F.when(x[m - 1].isNotNull() & qualifies(x[:m], most, long), at).otherwise(out)
        return out

    places = F.transform(F.sequence(F.lit(0), F.size("seq") - 1), pick)
    rows = seq.select("doc_id", "tag", "seq", F.explode(F.array_distinct(F.filter(places, lambda p: p.isNotNull()))).alias("p"))
    first = F.greatest(F.col("p") - (most - 1), F.lit(0))
    return rows.select("doc_id", "tag", F.get("seq", F.col("p"))["h"].alias("print"), "p", F.slice("seq", first + 1, 2 * most - 1).alias("near"), (F.col("p") - first).alias("q"))


def extended(prints: DataFrame, most: int, long: int) -> DataFrame:
    """(doc_id, tag, j, w, v, lines): the qualifying runs of up to ``most`` lines that hold a position: where it begins, its hashes and lines."""
    runs = []
    for size in range(1, most + 1):
        for back in range(size):
            at = F.col("q") - back
            x = [F.get("near", at + k) for k in range(size)]
            whole = (at >= 0) & x[-1].isNotNull() & qualifies(x, most, long)
            run = F.struct((F.col("p") - back).alias("j"), F.xxhash64(*[e["h"] for e in x]).alias("w"), F.hash(*[e["m"] for e in x]).alias("v"), F.array(*[e["at"] for e in x]).alias("lines"))
            runs.append(F.when(whole, run))
    return prints.select("doc_id", "tag", F.explode(F.filter(F.array(*runs), lambda r: r.isNotNull())).alias("r")).select("doc_id", "tag", "r.*")


def marks(docs: DataFrame, most: int, long: int) -> DataFrame:
    """(doc_id, tag, gone): the lines of later repeated runs."""
    prints = stored(fingerprints(sequences(docs), most, long), "line-prints")
    repeated = prints.groupBy("print").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("print")
    runs = stored(extended(prints.join(repeated.hint("merge"), "print"), most, long), "line-runs")
    place = F.struct("doc_id", "tag", "j")
    first = runs.groupBy("w", "v").agg(F.min(place).alias("a"), F.max(place).alias("z")).filter("a <> z").select("w", "v", "a")
    later = runs.join(first.hint("merge"), ["w", "v"]).filter(place > F.col("a"))
    return stored(later.groupBy("doc_id", "tag").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone")), "line-marks")


def split_docs(docs: DataFrame, most: int, long: int) -> tuple[DataFrame, DataFrame, str, str]:
    """(documents that surely have no marks, the others with their lines instead of the text and the marked places or null), both new columns' names."""
    gone, lines = free(docs, "_gone"), free(docs, "_lines")
    found = marks(docs.select("doc_id", F.col("text").cast("string").alias("text")), most, long)
    maybe, rest = parted(docs, found.select("doc_id"))
    i, t, key = (free(docs, c) for c in ("_id", "_tag", "_key"))
    found = found.select(F.col("doc_id").alias(i), F.col("tag").alias(t), F.col("gone").alias(gone))
    text = F.col("text").cast("string")
    # split before the join: what the lines are read from is then an array, not a split for each line
    keyed = maybe.select(*[quoted(c) for c in docs.columns if c != "text"], F.split(text, "\n", -1).alias(lines), F.xxhash64(text).alias(key))
    met = keyed.join(found.hint("merge"), (F.col("doc_id").cast("long") == F.col(i)) & (F.col(key) == F.col(t)), "left")
    return rest, met, lines, gone


def kept_text(lines: str, gone: str) -> Column:
    n = F.size(lines)
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone)), lambda i: F.get(lines, i))
    return F.array_join(F.when(F.col(gone).isNull(), F.col(lines)).otherwise(left), "\n")


def line_report(docs: DataFrame, *, lines: int = LINES, long: int = LONG) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text."""
    rest, met, parts, gone = split_docs(docs.select("doc_id", "text"), lines, long)
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    text = F.col("text").cast("string")
    rest = rest.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), text.alias("text"))
    return rest.unionAll(met.select(F.col("doc_id").cast("long").alias("doc_id"), count(parts).alias("n_lines"), count(gone).alias("n_removed"), kept_text(parts, gone).alias("text")))


def dedup(docs: DataFrame, *, lines: int = LINES, long: int = LONG) -> DataFrame:
    """The documents without later repeated runs; one of which nothing but blanks is left was a copy, and goes."""
    rest, met, parts, gone = split_docs(docs, lines, long)
    text = free(docs, "_text")
    met = met.withColumn(text, kept_text(parts, gone)).filter(F.col(gone).isNull() | (F.btrim(text, F.lit(BLANK + "\n")) != ""))
    same = lambda c, t: F.when(F.col(gone).isNull(), quoted(c)).otherwise(F.length(text).cast(t)).alias(c) if c == "n_chars" and t in ("bigint", "int") else quoted(c)
    return rest.unionAll(met.select(*[F.col(text).alias(c) if c == "text" else same(c, t) for c, t in docs.dtypes]))


def sql(lines: int = LINES, long: int = LONG) -> str:
    runs = []
    for m in range(1, lines + 1):
        same, ats = (", ".join(f"lead({c}, {k}) OVER o" for k in range(m)) for c in ("line", "pos"))
        size = " + ".join(f"strlen(lead(line, {k}) OVER o)" for k in range(m))
        runs.append(f"SELECT doc_id, pos, [{same}] AS w, [{ats}] AS ats, lead(pos, {m - 1}) OVER o IS NOT NULL AND {'TRUE' if m == lines else f'{size} >= {long}'} AS whole FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)")
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT * FROM l WHERE translate(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '') <> ''),
u AS ({' UNION ALL '.join(runs)}),
g AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM u WHERE whole),
gone AS (SELECT DISTINCT doc_id, unnest(ats) AS pos FROM g WHERE k > 1),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
 FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, r.text FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
