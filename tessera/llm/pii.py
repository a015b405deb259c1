"""Personal data: base spans by pattern, and terms that give protected entities away by how the corpus uses them.

DataFrame expressions only. A pattern's matches are marked with a control character by one regex replacement and the
text is split at the marks; positions are running sums of the pieces' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Fixed by the task: kinds in their order. The patterns match what the plain ones match, written so that a long run
#: of characters is walked once: a match can only begin where a run begins or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a valid match of the kind at all; cheaper to look for than the matches.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda text: text.contains("+"),
}
KINDS = (*PATTERNS, "term")
WORD = r"\p{L}+"

#: Stands before and after each match. One that is in the text is read as another character that no pattern holds.
MARK, OTHER = "\x01", "\x02"

#: Characters beside an entity in which its neighbouring words are looked for, and how many words on each side.
REACH, NEIGHBOURS = 96, 4

#: A term is generalised where it carries this share of an entity kind's information, and removed from the second on.
GENERALISE, REMOVE = 0.90, 0.95
#: Different entities of a kind, or different passages around one entity, that a term must stand beside, and
#: occurrences elsewhere that are taken for granted.
SUPPORT, PRIOR = 5, 5.0

#: Elements that a scan over an array takes at a time, and characters of the blocks that a text is cut from.
SCAN, BLOCK = 256, 4096

#: Terms up to which the small side of a join is broadcast; beyond it both sides are shuffled.
BROADCAST_TERMS = 20_000


def scan(values: Column, start: Column, step) -> Column:
    """What step gives for the elements before each element. In blocks, since each append copies its array, so that
    the work is in proportion to the array."""

    def fold(part: Column, first: Column) -> Column:
        empty = F.struct(first.alias("sum"), F.filter(F.array(first), lambda x: F.lit(False)).alias("out"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(step(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    def joined(blocks: Column) -> Column:
        starts = fold(F.transform(blocks, lambda b: b["sum"]), start)["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda x: step(x, s))))

    def scanned(given: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / SCAN).cast("int")), lambda b: fold(F.slice(given, b * SCAN + 1, SCAN), start))
        return F.when(F.size(given) > 0, F.flatten(F.transform(F.array(blocks), joined))).otherwise(F.filter(F.array(start), lambda x: F.lit(False)))

    # one-element arrays bind what is used more than once to a name, so that it is computed once
    return F.flatten(F.transform(F.array(values), scanned))


def running_sums(sizes: Column) -> Column:
    """Sum of the elements before each element of an int array."""
    return scan(sizes, F.lit(0), lambda a, x: a + x)


def marked(text: Column, pattern: str) -> Column:
    """The text in pieces: the 2nd, 4th ... are the pattern's matches, the others what lies between."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a correct check digit."""
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = digits_only(text)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_only(text)).between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,end:int,value:string,left:string,right:string>"


def spans(parts: Column, kind: str, context: bool) -> Column:
    """Array of the valid matches among marked pieces, with the text beside them where `context` asks for it."""

    def beside(piece: Column, right: bool) -> Column:
        near = F.left(piece, F.lit(REACH)) if right else F.right(piece, F.lit(REACH))
        # what the window cuts off is no whole word; the piece's own end is one
        return F.when(F.length(piece) >= REACH, near).otherwise(F.concat(near, F.lit(" ")) if right else F.concat(F.lit(" "), near))

    none = F.lit(None).cast("string")

    def each(starts: Column) -> Column:
        def one(i: Column) -> Column:
            piece = F.get(parts, i)
            return F.struct(
                F.get(starts, i).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (F.get(starts, i) + F.length(piece)).alias("end"),
                piece.alias("value"),
                (beside(F.get(parts, i - 1), False) if context else none).alias("left"),
                (beside(F.get(parts, i + 1), True) if context else none).alias("right"),
            )

        found = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)
        return F.filter(found, lambda s: valid(kind, s["value"]))

    # a one-element array binds the running sums to a name, so that they are computed once
    sums = F.array(running_sums(F.transform(parts, lambda p: F.length(p))))
    return F.when(F.size(parts) > 1, F.flatten(F.transform(sums, each))).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_base_spans(docs: DataFrame, text_col: str, context: bool = False) -> DataFrame:
    """Adds `_text` (null as empty) and one array of spans for each kind, `_email` and so on."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col("_text")
    out = out.withColumns({f"_parts_{k}": F.when(HINTS[k](text), marked(text, p)).otherwise(F.array(text)) for k, p in PATTERNS.items()})
    out = out.withColumns({f"_{k}": spans(F.col(f"_parts_{k}"), k, context) for k in PATTERNS})
    return out.drop(*(f"_parts_{k}" for k in PATTERNS))


def text_terms(text: Column) -> Column:
    """The text's words, lowered, in order: runs of letters, and an empty string at an end without one."""
    return F.split(F.lower(text), r"[^\p{L}]+", -1)


def neighbours(span: Column) -> Column:
    """The nearest whole words beside a span."""
    left = F.regexp_extract_all(F.lower(span["left"]), F.lit(r"(?<=[^\p{L}])\p{L}+"), F.lit(0))
    right = F.regexp_extract_all(F.lower(span["right"]), F.lit(r"\p{L}+(?=[^\p{L}])"), F.lit(0))
    return F.concat(F.reverse(F.slice(F.reverse(left), 1, NEIGHBOURS)), F.slice(right, 1, NEIGHBOURS))


def disclosing_terms(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(term, kind, disclosure, action) of the terms that reveal a protected entity, or a kind of them, beyond the
    threshold.

    Over all documents, p(x | term) is the share of the term's occurrences that stand beside x (with `prior`
    occurrences elsewhere added), p(x) the share of all words that do; x is one entity, such as an address, or all of
    its kind. The pointwise mutual information of term and x, log p(x|term)/p(x), over the information of x, -log p(x),
    is the disclosure: 1 where the term stands for x, 0 where it tells nothing. Beside an entity are the NEIGHBOURS
    words on each side within REACH characters. A term must stand beside `support` different entities of the kind, or
    in `support` different passages beside the one entity, so that copies of a passage prove nothing. Of several x the
    most disclosed one is kept, ties to the first kind. Null and empty texts and empty tables give no terms.
    """
    base = with_base_spans(docs.select(F.col(text_col).alias("text")), "text", context=True)
    context = F.flatten(F.transform(F.concat(*(F.col(f"_{k}") for k in PATTERNS)), lambda s: F.transform(neighbours(s), lambda w: F.struct(s["rank"].alias("rank"), F.xxhash64(s["value"]).alias("entity"), F.xxhash64(s["left"], s["right"]).alias("passage"), w.alias("term")))))
    seen = materialize(base.select(F.size(text_terms(F.col("_text"))).alias("n_words"), context.alias("near")))
    words = seen.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    share = F.lit(float(max(words, 1)))
    # passages first, then entities, so that no entity's or term's rows meet in one task
    passages = seen.select(F.explode("near").alias("x")).select("x.*").groupBy("rank", "term", "entity", "passage").agg(F.count("*").alias("n"))
    pairs = materialize(passages.groupBy("rank", "term", "entity").agg(F.sum("n").alias("n_near"), F.count("*").alias("n_passages")))
    beside = materialize(pairs.groupBy("rank", "term").agg(F.sum("n_near").alias("n_near"), F.count("*").alias("n_entities")))
    kinds = beside.groupBy("rank").agg((F.sum("n_near") / share).alias("p"))
    # of one entity, copies of a passage count once
    entities = pairs.groupBy("rank", "entity").agg((F.sum("n_passages") / share).alias("p"))
    of_kind = beside.where(F.col("n_entities") >= support).join(F.broadcast(kinds), "rank").select("rank", "term", "n_near", "p")  # a row for each kind
    of_one = pairs.where(F.col("n_passages") >= support).join(entities, ["rank", "entity"]).select("rank", "term", F.col("n_passages").alias("n_near"), "p")
    candidates = materialize(of_kind.unionByName(of_one))
    names = materialize(candidates.select("term").distinct())
    if names.count() <= BROADCAST_TERMS:
        names = F.broadcast(names)
    counts = docs.select(F.explode(text_terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).where("term <> ''").join(names, "term").groupBy("term").agg(F.count("*").alias("n_all"))
    told = candidates.join(counts, "term")
    p = F.least("n_near", "n_all") / (F.col("n_all") + F.lit(prior))
    ic = -F.log(F.least("p", F.lit(0.5)))
    told = told.withColumn("disclosure", (F.log(p) + ic) / ic)
    best = told.where(F.col("disclosure") >= generalise).groupBy("term").agg(F.max(F.struct("disclosure", (-F.col("rank")).alias("r"))).alias("m"))
    return best.select(
        "term",
        F.element_at(F.array(*(F.lit(k) for k in PATTERNS)), (1 - F.col("m.r")).cast("int")).alias("kind"),
        F.col("m.disclosure").alias("disclosure"),
        F.when(F.col("m.disclosure") >= remove, "remove").otherwise("generalise").alias("action"),
    )


def _term_spans(hits: Column, text: Column) -> Column:
    """Spans of the words in `hits` (array of struct term, action)."""

    def each(parts: Column) -> Column:
        def located(starts: Column) -> Column:
            def one(i: Column) -> Column:
                piece = F.get(parts, i)
                hit = F.get(F.filter(hits, lambda h: h["term"] == F.lower(piece)), F.lit(0))
                return F.struct(F.get(starts, i).alias("start"), F.lit(len(KINDS) - 1).alias("rank"), (F.get(starts, i) + F.length(piece)).alias("end"), hit["action"].alias("value"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))

            return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)

        sums = F.array(running_sums(F.transform(parts, lambda p: F.length(p))))
        return F.flatten(F.transform(sums, located))

    found = F.flatten(F.transform(F.array(marked(text, WORD)), each))
    return F.when(F.size(hits) > 0, F.filter(found, lambda s: s["value"].isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Stands for the start of a base span where none follows.
FAR = (1 << 31) - 1


def _apart(found: Column) -> Column:
    """Of sorted spans the base ones, and the terms that touch none of them."""
    term = len(KINDS) - 1

    def kept(spans_: Column) -> Column:
        # the farthest end of the base spans before each span, and the next start of those after it
        before = scan(F.transform(spans_, lambda s: F.when(s["rank"] < term, s["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
        after = F.reverse(scan(F.reverse(F.transform(spans_, lambda s: F.when(s["rank"] < term, s["start"]).otherwise(F.lit(FAR)))), F.lit(FAR), lambda a, x: F.least(a, x)))
        told = F.arrays_zip(spans_.alias("span"), before.alias("before"), after.alias("after"))
        free = F.filter(told, lambda t: (t["span"]["rank"] < term) | ((t["before"] <= t["span"]["start"]) & (t["after"] >= t["span"]["end"])))
        return F.transform(free, lambda t: t["span"])

    return F.when(F.exists(found, lambda s: s["rank"] == term), F.flatten(F.transform(F.array(found), kept))).otherwise(found)


def find_pii(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_text`, the arrays of base spans, and `_spans`: all spans by start, then kind.

    terms: (term, action), as disclosing_terms gives them. Up to BROADCAST_TERMS of them are compared within each row;
    more are joined with the documents' words.
    """
    out = with_base_spans(docs, text_col)
    base = F.concat(*(F.col(f"_{k}") for k in PATTERNS))
    n = terms.count()
    if n == 0:
        hits = F.array().cast("array<struct<term:string,action:string>>")
    elif n <= BROADCAST_TERMS:
        # the terms travel as one row; its size is checked above
        out = out.join(F.broadcast(terms.agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_actions"))))
        met = F.array_intersect(text_terms(F.col("_text")), F.map_keys("_actions"))
        hits = F.transform(met, lambda w: F.struct(w.alias("term"), F.element_at(F.col("_actions"), w).alias("action")))
    else:
        met = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).select(F.sha2("_text", 256).alias("_key"), F.explode(F.array_distinct(text_terms(F.col("_text")))).alias("term")).distinct()
        listed = met.join(terms.select("term", "action"), "term").groupBy("_key").agg(F.collect_list(F.struct("term", "action")).alias("_met"))
        out = out.withColumn("_key", F.sha2("_text", 256)).join(listed, "_key", "left")
        hits = F.coalesce(F.col("_met"), F.array().cast("array<struct<term:string,action:string>>"))
    out = out.withColumn("_base", base).withColumn("_hits", hits)
    out = out.withColumn("_terms", _term_spans(F.col("_hits"), F.col("_text")))
    out = out.withColumn("_base", F.array_sort("_base")).withColumn("_spans", F.array_sort(F.concat("_base", "_terms")))
    return out.withColumn("_spans", _apart(F.col("_spans"))).drop("_hits", "_terms", "_actions", "_met", "_key")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, found: Column) -> Column:
    """The text with each span replaced: base spans by [EMAIL] and so on, terms by [TERM] or by nothing.

    Spans that overlap are covered by the first one's label. The text is cut from blocks, since finding a place in a
    string walks it from its start.
    """
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(blocks: Column, ends: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
            return F.substring(some, a - first * BLOCK + 1, b - a)

        def one(s: Column, i: Column) -> Column:
            at = F.get(ends, i)
            label = F.when((s["rank"] == len(KINDS) - 1) & (s["value"] == "remove"), F.lit("")).otherwise(F.get(labels, s["rank"]))
            return F.when(s["start"] >= at, F.concat(between(at, s["start"]), label)).otherwise(F.lit(""))

        last = F.greatest(F.get(ends, F.size(ends) - 1), F.element_at(found, -1)["end"])
        return F.concat(F.array_join(F.transform(found, one), ""), between(last, F.lit(BLOCK) * F.size(blocks)))

    # one-element arrays bind what is used often to names
    given = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), scan(F.transform(found, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)).alias("ends")))
    return F.when(F.size(found) > 0, F.element_at(F.transform(given, lambda g: replaced(g["blocks"], g["ends"])), 1)).otherwise(text)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each document.

    Null texts count as empty: no spans and the digest of nothing. Rows are independent once the terms are known;
    repeated rows count as often as they stand there. Terms come from all documents. Texts of any length are read whole;
    other columns, of whatever name, are not read, and an empty table gives none.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find_pii(given, materialize(disclosing_terms(given)))
    return found.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_term"),
    )
