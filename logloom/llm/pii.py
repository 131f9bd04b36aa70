"""Personal data: fixed patterns, and more identifiers found through the words around them.

The matches of the fixed patterns are seeds. A cue is a word with ``:``, ``=`` or ``#`` behind
it, the one to three words before a unit of text, or the one or two after it. Units are
identifiers, groups of digits and words in any script; punctuation between them is no part of
a cue. Whatever stands at a cue, personal or not, is an instance of it. Cues and instances form
a graph that is scored in rounds: a cue by the mean confidence of its instances, an instance
that is no seed by its best cue. Cues with enough seeds and a high score discover what stands
at them, though no fixed pattern knows it. Cues with fewer seeds than ``least_seeds``, or with a
smaller part of them among their instances than ``least_share``, never count. Instances are
gathered and counted exactly for all others, and for no cue that has by far too many of them; so what is
gathered grows with the seeds, not with the words. Cues and instances are told apart by 64-bit hashes.

All of it is DataFrame expressions. Matches are placed by the lengths of what lies between
them. The patterns are the fixed ones with possessive repeats and starts only where a run of
characters begins (or the last match ended); that finds the same matches in linear time.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; other
columns are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import stage, unstage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_ERROR = 0.1  # standard error of an estimated number of instances
_MARGIN = 4

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CUE = r"""(?<![A-Za-z_.-])[A-Za-z][A-Za-z_.-]*+\x20?[:=#]\x20?["']?"""
_CUED = _CUE + r"""[A-Za-z0-9+(][^\s"',;|]*+(?:\x20[().0-9-]++)*+"""

_CORE = r"""[^\s\p{Z},;|<>"'!?:=#]"""
_NUMBER = rf"[+(]*+[0-9][().0-9-]*+(?!{_CORE})(?:(?<=[0-9)])\x20[().-]*+[0-9][().0-9-]*+(?!{_CORE}))*+"
_WORD = rf"(?:[+(]++(?=[0-9])|[\p{{L}}\p{{N}}_]){_CORE}*+"
_UNIT = rf"{_PHONE}(?![0-9])|{_EMAIL}|{_IP}(?!\.?{_CORE})|{_CARD}(?!\.?[^\s\p{{Z}},;|<>\"'!?:=#).])|{_NUMBER}|{_WORD}"


def _placed(text: Column, pattern: str, known: Column) -> Column:
    """Array of ``(start, m)`` for the matches of ``pattern``; ``known`` tells texts that can have one."""
    p = F.lit(pattern)
    between = F.split(text, pattern, -1)
    both = F.zip_with(between, F.regexp_extract_all(text, p, F.lit(0)), lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        one = F.array(F.struct(start.alias("start"), x["m"].alias("m")))
        return F.struct(
            (start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    return F.when(known & text.rlike(pattern), F.aggregate(both, begin, step)["out"]).otherwise(begin["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))


def _spans(found: Column, kind: str, rank: int, valid) -> Column:
    kept = F.filter(found, lambda x: valid(x["m"]))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (x["start"] + F.length(x["m"])).alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Array of ``(start, rank, end, kind)`` of the fixed patterns, by start, then kind."""
    digit = text.rlike("[0-9]")
    found = (
        _spans(_placed(text, _EMAIL, F.contains(text, F.lit("@"))), "email", 0, lambda m: F.lit(True)),
        _spans(_placed(text, _IP, digit), "ip", 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        _spans(_placed(text, _CARD, digit), "card", 2, _is_card),
        _spans(_placed(text, _PHONE, F.contains(text, F.lit("+"))), "phone", 3, lambda m: F.length(_digits(m)).between(9, 15)),
    )
    return F.array_sort(F.concat(*found))


def cued(text: Column) -> Column:
    """Array of ``(cue, start, end, value)``: what stands behind cues."""
    able = F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | F.contains(text, F.lit("#"))

    def one(x: Column) -> Column:
        lead = F.regexp_extract(x["m"], "^" + _CUE, 0)
        value = F.regexp_replace(F.substring(x["m"], F.length(lead) + 1, F.length(x["m"])), "[\\x20().!?-]++$", "")
        start = x["start"] + F.length(lead)
        return F.struct(
            F.lower(F.regexp_replace(lead, "[\\x20\"']", "")).alias("cue"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
        )

    return F.transform(_placed(text, _CUED, able), one)


def _is_seed(value: Column) -> Column:
    """Whether a fixed pattern knows the whole unit."""
    n = F.length(_digits(value))
    address = value.rlike(f"^(?:{_EMAIL})$") | value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    number = value.rlike(f"^{_CARD}$") & _is_card(value) | value.rlike(f"^{_PHONE}$") & n.between(9, 15)
    return F.when(value.rlike("[0-9@]"), F.contains(value, F.lit("@")) & address | (n >= 4) & (address | number)).otherwise(
        F.lit(False)
    )


def units(rows: DataFrame, *wanted: str) -> DataFrame:
    """``row, at, seed, cue`` for the units ``u`` of ``rows``, one row for each cue around a unit.

    ``wanted`` adds ``n`` and ``key``, a unit's length and hash.
    """
    word = F.transform("u", lambda x: F.xxhash64(F.lower(F.btrim(x, F.lit(" ().!?-_")))))
    value = F.transform("u", lambda x: F.rtrim(x, F.lit(" ().!?-")))
    made = rows.filter(F.size("u") > 1).select("row", "seeds", word.alias("w"), value.alias("v"), F.size("u").alias("many"))
    none = F.lit(None).cast("long")
    parts = {
        "seed": F.col("seeds"),
        **{k: F.transform("v", f) for k, f in (("n", F.length), ("key", lambda x: F.xxhash64(x))) if k in wanted},
        **{f"b{k}": F.concat(F.array_repeat(none, k), "w") for k in (1, 2, 3)},
        **{f"a{k}": F.slice("w", k + 1, F.col("many")) for k in (1, 2)},
    }
    each = made.select("row", "many", F.posexplode(F.arrays_zip(*[c.alias(k) for k, c in parts.items()])).alias("at", "x"))
    each = each.filter(F.col("at") < F.col("many"))
    around = {"b1": ["b1"], "b2": ["b2", "b1"], "b3": ["b3", "b2", "b1"], "a1": ["a1"], "a2": ["a1", "a2"]}
    # the farthest word is there only if those between are
    cues = [
        F.when(F.col("x")[max(w)].isNotNull(), F.xxhash64(F.lit(k), *[F.col("x")[j] for j in w])) for k, w in around.items()
    ]
    found = each.select("row", "at", "x.seed", *[f"x.{k}" for k in wanted], F.explode(F.array(*cues)).alias("cue"))
    return found.filter("cue IS NOT NULL")


def scored_cues(edges: DataFrame, rounds: int = 3, least_seeds: int = 3, least_score: float = 0.7) -> DataFrame:
    """``cue``: those that may discover something, from ``edges(cue, value, seed)``.

    ``edges`` has a row for each cue and instance; ``seed`` tells instances that fixed
    patterns know. A cue needs ``least_seeds`` different seeds and ``least_score``.
    """
    seed = F.col("seed").cast("double")
    conf, scored = edges.withColumn("conf", seed), None
    for i in range(rounds):
        mean = conf.groupBy("cue").agg(F.avg("conf").alias("score"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        scored = stage(mean.filter(F.col("seeds") >= least_seeds).select("cue", "score"))
        if i + 1 < rounds:
            # a seed's confidence is 1 whatever its cues are, so only other instances meet their cues
            other = edges.filter("NOT seed").join(scored, "cue")
            best = other.groupBy("value").agg(F.max("score").alias("best"))
            conf = edges.join(best, "value", "left").withColumn("conf", F.greatest(seed, F.coalesce("best", F.lit(0.0))))
    return scored.filter(F.col("score") >= least_score).select("cue")


def find_pii(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_seeds: int = 3,
    least_share: float = 0.1,
) -> DataFrame:
    """One row per row of ``df``: ``id`` and ``spans``, an array of ``(start, rank, end, kind)``.

    Base spans have ranks 0 to 3, discovered ones rank 4 and kind ``context``; these never
    overlap a base span. What the texts hold is staged in the shared folder.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = df.select(F.col(id_column).alias("id"), text.alias("text"))
    u = F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0)).alias("u")
    found = found.select("id", "text", base_spans(F.col("text")).alias("base"), cued(F.col("text")).alias("cued"), u)
    seeds = F.transform("u", lambda x: _is_seed(F.rtrim(x, F.lit(" ().!?-"))))
    # places are told by lengths, so that no text is kept
    size = F.zip_with(
        F.split("text", _UNIT, -1), F.col("u"),
        lambda b, u: F.struct(F.length(b).alias("b"), F.coalesce(F.length(u), F.lit(0)).alias("u")),
    )
    found = found.select("id", "base", "cued", "u", seeds.alias("seeds"), size.alias("size"))
    rows = stage(found.withColumn("row", F.monotonically_increasing_id()), "zstd")

    def hit(c: Column, base: Column) -> Column:
        return F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    marked = rows.filter(F.size("cued") > 0).select(
        "row", F.explode(F.transform("cued", lambda c: F.struct(c.alias("c"), hit(c, F.col("base")).alias("seed")))).alias("x")
    )
    named = marked.select(
        "row",
        F.xxhash64(F.lit("label"), F.col("x.c.cue")).alias("cue"),
        F.xxhash64("x.c.value").alias("value"),
        F.col("x.c.start").alias("start"),
        F.col("x.c.end").alias("end"),
        F.col("x.seed").alias("seed"),
    )
    around = units(rows, "key")
    seeded = units(rows.filter(F.exists("seeds", lambda x: x)), "key").filter("seed").select("cue", "key").distinct()
    seeded = stage(seeded.groupBy("cue").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= least_seeds))
    # Where a cue has by far too many instances for its seeds, they aren't gathered. That a HyperLogLog sketch of 128
    # registers finds four times as many as there are has a chance below e^-80; equal hashes are likelier by far.
    many = around.join(seeded.select("cue"), "cue", "left_semi")
    many = many.groupBy("cue").agg(F.approx_count_distinct("key", _ERROR).alias("many"))
    able = stage(many.join(seeded, "cue").filter(_MARGIN * F.col("seeds") >= least_share * F.col("many")).select("cue"))
    near = around.join(able, "cue", "left_semi")
    near = stage(near.select("cue", F.col("key").alias("value"), "seed").distinct())
    shares = near.groupBy("cue").agg(F.avg(F.col("seed").cast("double")).alias("share")).filter(F.col("share") >= least_share)
    likely = near.join(shares.select("cue"), "cue", "left_semi")
    labels = named.groupBy("cue", "value").agg(F.max("seed").alias("seed"))
    edges = stage(likely.unionByName(labels))
    good = stage(scored_cues(edges, least_seeds=least_seeds))
    new = edges.filter("NOT seed").join(good, "cue", "left_semi").select("cue", "value")
    more = named.filter("NOT seed").join(good, "cue", "left_semi").join(new, ["cue", "value"], "left_semi")
    more = more.select("row", "start", "end")

    # Places are summed up only for texts in which something was discovered. These are staged first: where they are few,
    # the lengths of all others needn't be shuffled to meet them, and else they go as plain numbers, not as structs.
    at = units(rows, "n").filter("NOT seed").join(good, "cue", "left_semi")
    at = stage(at.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("at", "n")).alias("hits")))
    sized = rows.select("row", F.col("size.b").alias("between"), F.col("size.u").alias("of"))
    sized = sized.join(at, F.col("row") == F.col("__row")).select("row", "hits", "between", "of")

    def total(lengths: str, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)

    def place(h: Column) -> Column:
        start = total("between", h["at"] + 1) + total("of", h["at"])
        return F.struct(start.alias("start"), (start + h["n"]).alias("end"))

    placed = sized.select("row", F.explode(F.transform("hits", place)).alias("c")).select("row", "c.start", "c.end")
    more = more.unionByName(placed)
    more = more.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("start", "end")).alias("more"))  # of one text
    more = stage(more)

    def span(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), F.lit(4).alias("rank"), c["end"].alias("end"), F.lit(CONTEXT).alias("kind"))

    both = rows.join(more, F.col("row") == F.col("__row"), "left")
    apart = F.transform(F.filter("more", lambda c: ~hit(c, F.col("base"))), span)
    both = both.select("id", "base", apart.alias("more"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x != y)
    outer = F.filter("more", lambda x: ~F.exists("more", lambda y: inside(x, y)))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    result = stage(both.select("id", F.array_sort(F.concat("base", F.coalesce(outer, none))).alias("spans")))
    unstage(rows, seeded, able, near, edges, good, at, more)
    return result
