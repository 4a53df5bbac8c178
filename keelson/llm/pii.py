"""Operator 6: information-theoretic sanitisation, in DataFrame functions only.

Base matches (email, ip, card, phone) are the protected entities. Corpus co-occurrence estimates how strongly a word discloses one: with
n texts, n(t) having the word, n(c) the entity and n(c, t) both, anywhere in the text,

    P(c | t) = n(c, t) / n(t),   IC(c) = log(n / n(c)),   PMI(c; t) = log(P(c | t) / (n(c) / n)),   disclosure = PMI / IC.

Beyond GENERALISE a word is replaced by a general term, beyond REMOVE removed, wherever it stands outside base matches in a document that
holds the entity. Rare counts have no minimum, but removal asks for REMOVE of the disclosure by P shrunk to the entity's base rate,
(n(c, t) + PRIOR * n(c) / n) / (n(t) + PRIOR): a word seen once, beside an entity seen once, has P = 1/2 then and is
generalised, unless n passes about a million texts, where 1/2 discloses 0.95 of IC. Equal texts are one in all counts, so copies prove
nothing. A word is a run of two or more letters, marks and digits, or one ideograph: a lone letter stays. Words that a text has by chance alone are generalised too, if few others have them.

Nothing is cut: pairs are dropped before counting only where n(c) texts with both could not reach the threshold. Entities with the same
texts have the same estimates and are counted as one, so a text with many of them is no product of entities and words.

Patterns are the contract's, with possessive loops and a look-behind: the same matches, without recursion or quadratic rescans on very
long runs. Offsets are code points, ends exclusive.

Defined cases: null text is empty; rows with the same text are one in counts and get the same spans; a null
doc_id takes no part in counts and has base spans only; an empty table gives no rows; a very long text is searched whole (the replacing of
its spans by ``sanitize`` costs spans times length); other columns, whatever their names, are ignored, and kept by ``sanitize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import free, parted, quoted, stored

# The contract's patterns, written so that Java neither recurses nor rescans.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[\p{L}\p{M}\p{N}]{2,}+|\p{IsIdeographic}"
#: Up to so many characters, and on to the end of a word: offsets add up over pieces, words over one piece only.
PIECE = r"(?s).{1,512}+[\p{L}\p{M}\p{N}]*+"
#: Parts whose offsets add up one by one.
STEP = 64
PRIOR = 1.0
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def laid_out(parts: Column, length, row, kind: str) -> Column:
    """``row(part, offset)`` for each part, which stand one after the other. Offsets add up in blocks of STEP, so that long lists aren't quadratic."""
    none = F.lit([]).cast(kind)

    def block(p: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(p, start, lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(row(x, acc["at"]))).cast(kind).alias("out")), lambda acc: acc["out"])

    def blocks(p: Column) -> Column:
        count = F.ceil(F.size(p) / STEP).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(p, k * STEP + 1, STEP))
        zero = F.lit(0).cast("long")

        def placed(c: Column) -> Column:
            sizes = F.transform(c, lambda x: F.aggregate(x, zero, lambda acc, y: acc + length(y)))
            return let(sizes, lambda z: F.flatten(F.transform(c, lambda x, k: block(x, F.aggregate(F.slice(z, F.lit(1), k), zero, lambda acc, y: acc + y)))))

        return F.when(count > 0, let(cut, placed)).otherwise(none)

    return let(parts, blocks)


def matches_of(text: Column, pattern: str, kind: str, good) -> Column:
    """Matches as structs: the gaps that split leaves and the matches themselves add up to the offsets."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def span(p: Column, at: Column) -> Column:
        begin = at + F.length(p["gap"])
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(p["hit"])).alias("end"), p["hit"].alias("value"))

    def spans_of(hits: Column) -> Column:
        zipped = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.filter(laid_out(zipped, lambda p: F.length(p["gap"]) + F.length(p["hit"]), span, SPAN), lambda s: good(s["value"]))

    return F.coalesce(let(found, lambda hits: F.when(F.size(hits) > 0, spans_of(hits))), F.lit([]).cast(SPAN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    rev = F.reverse(digits(m))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), add) % 10 == 0


def octet(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+", "")
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


GOOD = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), octet),
    "card": lambda m: F.length(digits(m)).between(16, 19) & luhn(m),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """All base matches, by kind as listed, then by start."""
    none = F.lit([]).cast(SPAN)
    parts = []
    for kind, pattern in PATTERNS.items():
        found = matches_of(text, pattern, kind, GOOD[kind])
        parts.append(found if NEEDS[kind] is None else F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none))
    return F.concat(*parts)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def hashed(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def detected(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, tag (of the text), base spans, text (null if there are none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", "tag", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def bags(docs: DataFrame) -> DataFrame:
    """Per text: tag, hashes of its words. Words of a text move only if the text may be there twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.filter("doc_id IS NOT NULL").select(F.xxhash64(text).alias("tag"), text.alias("text"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), hashed))
    again = stored(tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tag"), "pii-again")
    maybe, once = (d.select("tag", words.alias("words")) for d in parted(tagged, again, "tag"))
    return once.unionAll(maybe.groupBy("tag").agg(F.first("words").alias("words")))


def disclosing(docs: DataFrame, found: DataFrame, generalise: float, remove: float) -> DataFrame:
    """Per text: tag, gone and general (hashes of the words beyond the thresholds for an entity of the text)."""
    texts = stored(bags(docs), "pii-words")
    n = float(max(texts.count(), 1))
    entity = F.xxhash64(F.col("s.kind"), F.lower("s.value"))
    held = found.filter("doc_id IS NOT NULL").filter(F.size("base") > 0).select("tag", F.explode("base").alias("s")).select("tag", entity.alias("entity")).distinct()
    alike = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.bit_xor("tag").alias("x"), F.bit_xor(F.xxhash64("tag")).alias("y")).select("entity", "n_c", F.xxhash64("n_c", "x", "y").alias("c"))
    held = stored(held.join(alike, "entity").select("tag", "c", "n_c").distinct(), "pii-entities")
    seen = texts.select(F.explode("words").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    words = texts.join(held.select("tag").distinct(), "tag", "left_semi").select("tag", F.explode("words").alias("t")).join(seen, "t")

    def disclosure(n_ct: Column, prior: float = 0.0) -> Column:
        ic = F.log(F.lit(n) / F.col("n_c"))
        return F.when(ic > 0, 1 + F.log((n_ct + prior * F.col("n_c") / n) / (F.col("n_t") + prior)) / F.when(ic > 0, ic))

    pairs = words.join(held, "tag").filter(disclosure(F.least("n_c", "n_t")) >= generalise)
    pairs = stored(pairs, "pii-pairs")
    bad = pairs.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")).filter(disclosure(F.col("n_ct")) >= generalise)
    bad = bad.select("c", "t", (disclosure(F.col("n_ct"), PRIOR) >= remove).alias("go"))
    worst = pairs.select("tag", "c", "t").join(bad, ["c", "t"]).groupBy("tag", "t").agg(F.max("go").alias("go"))  # remove wins over generalise
    return worst.groupBy("tag").agg(F.collect_list(F.when(F.col("go"), F.col("t"))).alias("gone"), F.collect_list(F.when(~F.col("go"), F.col("t"))).alias("general"))


def terms(text: Column, base: Column, gone: Column, general: Column) -> Column:
    """Where the words of ``gone`` and ``general`` stand outside base matches, in order."""
    pieces = laid_out(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.length, lambda p, at: F.struct(at.alias("off"), p.alias("piece")), "array<struct<off:long,piece:string>>")

    def words(p: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < p["off"] + F.length(p["piece"])) & (b["end"] > p["off"]))
        hits = matches_of(p["piece"], WORD, "term", lambda w: F.array_contains(gone, hashed(w)) | F.array_contains(general, hashed(w)))
        out = F.transform(hits, lambda w: F.struct(w["kind"].alias("kind"), (p["off"] + w["start"]).alias("start"), (p["off"] + w["end"]).alias("end"), F.when(F.array_contains(gone, hashed(w["value"])), "remove").otherwise("generalise").alias("value")))
        return F.filter(out, lambda w: ~F.exists(near, lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))

    return F.flatten(F.transform(pieces, words)).cast(SPAN)


def spans(docs: DataFrame, *, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row: doc_id, tag, base, terms (array of kind, start, end, action as value)."""
    found = stored(detected(docs), "pii-base")
    bad = stored(disclosing(docs, found, generalise, remove), "pii-words-of-texts")
    met = found.join(bad.hint("merge"), "tag", "left")
    marked = F.col("doc_id").isNotNull() & F.col("gone").isNotNull()
    # looking for words costs time, not bytes: dealt to as many tasks as a shuffle has, whatever their size
    own = met.filter(marked).repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tag", "doc_id")
    cols = ["doc_id", "tag", "base"]
    return own.select(*cols, terms(F.col("text"), F.col("base"), F.col("gone"), F.col("general")).alias("terms")).unionAll(met.filter(~marked).select(*cols, F.lit([]).cast(SPAN).alias("terms")))


def report(docs: DataFrame, **thresholds: float) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_base (all four), base_sha256, spans, n_terms."""
    s = spans(docs, **thresholds)
    of = lambda k: F.filter("base", lambda b: b["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return s.select("doc_id", *counts, F.size("base").cast("long").alias("n_base"), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitize(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with entities as [EMAIL] and the like, disclosing words generalised to [TERM] or removed."""
    i, t, k, ours = (free(docs, c) for c in ("_id", "_tag", "_key", "_spans"))
    by = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["value"] == "remove", "").otherwise("[TERM]")
    ordered = F.array_sort(F.transform(F.concat("base", "terms"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), by(x).alias("by"))))
    s = spans(docs, **thresholds).filter("size(base) + size(terms) > 0").select(F.col("doc_id").alias(i), F.col("tag").alias(t), ordered.alias(ours)).dropDuplicates([i, t])
    text = F.col("text").cast("string")
    keyed = docs.withColumn(k, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(s, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(k) == F.col(t)), "left")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - acc["at"]).cast("int"))
        skip = x["start"] < acc["at"]  # inside one that is replaced already
        return F.struct(F.greatest(acc["at"], -x["minus"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, x["by"]))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    done = F.when(F.col(ours).isNull(), text).otherwise(F.aggregate(ours, start, step, rest))
    return joined.select(*[done.alias("text") if c == "text" else quoted(c) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
