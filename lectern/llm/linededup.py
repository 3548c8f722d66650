"""Lines that differ from an earlier line in one word at most, by a deletion-neighbourhood join.

An edit is a word replaced, put in or left out: a neighbourhood by letters would emit a key per letter of a
paragraph. Lines of few words, and of scripts without blanks, are read by their characters instead. DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.landing import landed

# Of fewer words one is not a small part: such lines are compared by characters, and as wholes if these are few as well.
MIN_WORDS, MIN_CHARACTERS = 4, 8
WORDS, CHARACTERS = 0, 1
# Lines of one length that share so many units at an end are compared.
HALF_BEGINS = 64
# Hashes are cut to 40 bits, so that the sum over a line of eight million words still fits.
KEY_SHIFT = 24
KEY = ["doc_id", "text_key"]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with its place, its words and a digest of them. Case and spacing do not matter."""
    lines = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select(*KEY, "line_no", _words(F.col("line")).alias("words"))
    return lines.withColumn("digest", F.unhex(F.md5(F.array_join("words", " "))))


def _words(line: Column) -> Column:
    """Words in lower case. White space is made one kind first, where there is another: splitting at a plain character is much the fastest."""
    lower, odd = F.lower(line), F.lit(False)
    blanks = lower
    for other in "\t\x0b\f\r":
        blanks, odd = F.replace(blanks, F.lit(other), F.lit(" ")), odd | F.contains(line, F.lit(other))
    plain = F.when(odd, blanks).otherwise(lower)
    return F.array_remove(F.split(plain, " "), "")


def _readings(words: Column) -> Column:
    """What a line is compared by: its words from three on, its characters if it has less than four words."""
    n = F.size(words)
    characters = F.split(F.array_join(words, " "), "")
    by_words = F.struct(F.lit(WORDS).alias("kind"), words.alias("units"))
    by_characters = F.struct(F.lit(CHARACTERS).alias("kind"), F.array_remove(characters, "").alias("units"))
    few = F.when(n == MIN_WORDS - 1, F.array(by_words, by_characters)).otherwise(F.array(by_characters))
    return F.when(n >= MIN_WORDS, F.array(by_words)).otherwise(few)


def _least(kind: Column) -> Column:
    return F.when(kind == WORDS, MIN_WORDS).otherwise(MIN_CHARACTERS)


def _halves(kind: Column, units: Column) -> Column:
    """Keys of which two lines within one edit share one at least.

    Of lines of n units, and of n and n + 1, one edit leaves the first n div 2 or the last n - n div 2 as they were.
    So a line has both for its own length and for one less. Of a long half the units at its outer end will do.
    """
    n, keys = F.size(units), []
    for less in (0, 1):
        length = n - less
        cut = F.floor(length / 2).cast("int")
        first, last = cut, length - cut
        first, last = F.least(first, F.lit(HALF_BEGINS)), F.least(last, F.lit(HALF_BEGINS))
        keys.append(F.xxhash64(kind, length * 2, F.slice(units, 1, first)))
        keys.append(F.xxhash64(kind, length * 2 + 1, F.slice(units, n - last + 1, last)))
    return F.when(n >= _least(kind) - 1, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def _begins(words: Column) -> Column:
    """Keys by the beginnings of halves, which most lines share with no other."""
    by_readings = F.flatten(F.transform(_readings(words), lambda r: _halves(r["kind"], r["units"])))
    return F.when(F.size(words) >= MIN_WORDS, _halves(F.lit(WORDS), words)).otherwise(by_readings)


def _shared(halves: DataFrame) -> DataFrame:
    """``half`` of more than one line."""
    return halves.groupBy("half").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("half")


def _variants(near: DataFrame) -> DataFrame:
    """For every unit of a line a key of the others, ``n, v1, v2``, and the line's own key ``t1, t2``.

    A key is the sum of hashes of the units with their places. Without one unit, those behind it move up one
    place; both sums run along the line, so all of a line's keys cost as much as reading it.
    """
    units = near.select("digest", "kind", "first", F.size("units").alias("n"), F.posexplode("units").alias("place", "unit"))
    along = Window.partitionBy("digest", "kind").orderBy("place")
    whole, upto = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for salt in (1, 2):
        stays = F.shiftright(F.xxhash64(F.lit(salt), "unit", "place"), KEY_SHIFT)
        moves = F.shiftright(F.xxhash64(F.lit(salt), "unit", F.col("place") - 1), KEY_SHIFT)
        before = F.sum(stays).over(upto) - stays
        behind = F.sum(moves).over(whole) - F.sum(moves).over(upto)
        units = units.withColumn(f"v{salt}", before + behind).withColumn(f"t{salt}", F.sum(stays).over(whole))
    return units.drop("unit")


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The distinct lines that share the beginning of a half with another one, as they are compared, with their first place."""
    begins = firsts.select("digest", F.explode("begins").alias("half"))
    candidates = begins.join(landed(_shared(begins), "begins").hint("shuffle_hash"), "half").select("digest").distinct()
    candidates = firsts.join(candidates.hint("shuffle_hash"), "digest").select("digest", "first")
    by_text = candidates.groupBy(F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key")).agg(
        F.collect_list(F.struct("digest", "first")).alias("wanted")
    )
    # One row for each text and small beside it: the texts are shuffled, but not sorted.
    by_text = landed(by_text, "candidates").hint("shuffle_hash")
    texts = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["of_id"]) & (docs["text_key"] == by_text["of_key"]))
    texts = texts.select("wanted", F.split("text", "\n").alias("parts"))
    found = F.transform("wanted", lambda w: F.struct(w["digest"].alias("digest"), w["first"].alias("first"), F.get("parts", w["first"]["line_no"]).alias("line")))
    lines = texts.select(F.explode(found).alias("w")).select("w.*")
    lines = lines.select("digest", "first", _words(F.col("line")).alias("words")).dropDuplicates(["digest"])
    return lines.select("digest", "first", F.explode(_readings(F.col("words"))).alias("r")).select("digest", "first", "r.*")


def _removed(near: DataFrame) -> DataFrame:
    """``digest`` of the distinct lines that have an earlier one within one edit.

    Lines that give the same variant at the same place differ in the unit at that place alone: of such a group
    all but the earliest go. A variant that is itself a line is one unit shorter than those it comes from: the
    later of the two goes. So every pair is judged, without a row per pair. What the keys bring together is
    verified on the units. Most keys come once: they are counted by a hash, and only the others are sorted and joined.
    """
    near = landed(near, "near")
    every = landed(_variants(near), "variants")
    key = ["kind", "n", "v1", "v2"]
    variants = every.where(F.col("n") >= _least(F.col("kind"))).withColumn("spot", F.xxhash64(*key))
    lines = every.where("place = 0").select("kind", (F.col("n") + 1).alias("n"), F.col("t1").alias("v1"), F.col("t2").alias("v2"),
                                            F.col("digest").alias("short"), F.col("first").alias("short_first"))
    lines = lines.withColumn("spot", F.xxhash64(*key))
    spots = variants.select("spot").unionByName(lines.select("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("m"))
    spots = landed(spots.where("m > 1").select("spot"), "spots").hint("shuffle_hash")
    variants = landed(variants.join(spots, "spot", "left_semi").drop("t1", "t2", "spot"), "together")
    lines = lines.join(spots, "spot", "left_semi").drop("spot")
    groups = variants.groupBy(*key, "place").agg(F.min(F.struct("first", "digest")).alias("lead"), F.count(F.lit(1)).alias("m"))
    groups = landed(groups.where("m > 1").select(*key, "place", "lead"), "groups")
    replaced = variants.join(groups, [*key, "place"]).where(F.col("digest") != F.col("lead.digest"))
    replaced = replaced.select("digest", "kind", F.col("lead.digest").alias("other"), "place", F.lit(0).alias("shorter"))

    later = F.col("first") > F.col("short_first")
    inserted = variants.join(lines, key).select(
        F.when(later, F.col("digest")).otherwise(F.col("short")).alias("digest"),
        "kind",
        F.when(later, F.col("short")).otherwise(F.col("digest")).alias("other"),
        "place",
        F.when(later, 2).otherwise(1).alias("shorter"),
    )
    links = replaced.unionByName(inserted)
    mine = near.select("digest", "kind", F.col("units").alias("a"))
    theirs = near.select(F.col("digest").alias("other"), "kind", F.col("units").alias("b"))
    links = links.join(mine, ["digest", "kind"]).join(theirs, ["other", "kind"])
    return links.where(_within_one_edit()).select("digest").distinct()


def _within_one_edit() -> Column:
    """The units but the one at the place are equal; ``shorter`` 1: ``a`` lacks it, 2: ``b`` does."""

    def without(units: str) -> Column:
        place = F.col("place")
        return F.concat(F.slice(units, 1, place), F.slice(units, place + 2, F.size(units)))

    a = F.when(F.col("shorter") == 1, F.col("a")).otherwise(without("a"))
    b = F.when(F.col("shorter") == 2, F.col("b")).otherwise(without("b"))
    return a == b


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row: its text without the lines that an earlier one repeats.

    A line goes if a line within one word's edit (replaced, put in or left out), or an equal one, comes earlier
    by ``doc_id`` and place; case and spacing do not count. Lines of three words are so compared with lines of four
    only. Lines of less than four words, among them those of scripts without blanks, are compared with one another by
    characters: one replaced, put in or left out, the longer having eight at least. All others are compared as wholes.
    It is judged on the input: also a line that goes itself makes later ones go. ``n_lines`` counts all lines, also
    those without a word, which always stay.

    Null and empty texts have no line with a word; a null text is empty. Rows without ``doc_id`` come first.
    Rows that repeat an id and text are one document: all of them keep the first's lines. Columns other than
    ``doc_id`` and ``text`` are not read. An empty table gives none.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    at = F.struct("doc_id", "text_key", "line_no")
    # Lines without a word are left out only as they are read back: a filter here would compute the words twice.
    lines = _lines(own).select(*KEY, "line_no", "digest", _begins(F.col("words")).alias("begins"), F.size("words").alias("n"))
    lines = landed(lines, "lines").where("n > 0").drop("n")
    firsts = lines.groupBy("digest").agg(F.min(at).alias("first"), F.first("begins").alias("begins"), F.count(F.lit(1)).alias("n_lines"))
    firsts = landed(firsts, "firsts")
    removed = landed(_removed(_near(own, firsts)), "removed")

    marked = firsts.join(removed.withColumn("near", F.lit(True)), "digest", "left").where("n_lines > 1 OR near")
    marked = landed(marked.select("digest", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    gone = lines.drop("begins").join(marked.hint("shuffle_hash"), "digest").where(F.col("near") | (at != F.col("first")))
    gone = landed(gone.groupBy(*KEY).agg(F.collect_set("line_no").alias("gone")), "gone")
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "gone")
    gone = gone.hint("shuffle_hash")
    joined = own.join(gone, own["doc_id"].eqNullSafe(gone["_doc_id"]) & (own["text_key"] == gone["_text_key"]), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(
        "doc_id",
        (breaks + 1).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
