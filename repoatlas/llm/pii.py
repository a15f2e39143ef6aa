"""Personal data: typed patterns, and identifiers found through their contexts.

The typed patterns (e-mail, IP, card, phone) find the base spans, the seeds of a
bootstrap. Each text is cut into units, short runs of digit groups or words. The
word before a unit, the two words before it and the two after it are its
patterns. Patterns and units form a graph over the whole corpus. A pattern's
score is the trusted share of all its different units, ordinary words included;
a unit is trusted if it is a seed or stands in a confident pattern. Patterns of
newly trusted units enter the graph, until nothing changes. Units in confident
patterns that look like identifiers are spans that no typed pattern knows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions.arrays import bind
from repoatlas.llm.rows import text_key, whole_rows
from repoatlas.llm.tasks import text_of
from repoatlas.operators.skew import lookup_join
from repoatlas.session import written

# The kinds in order, with the pattern of each.
#
# The e-mail and IP patterns may only begin where a run of their characters
# begins, or where the last match ended, which finds the same matches without
# trying every place of a run. Possessive repeats never give back, since what
# follows them is not of their characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")

# A base span in a text whose base spans are masked, one character for each of theirs.
MASK = "\ue000"
# The units of a masked text: a masked span, else up to six groups of digits as
# in "(614) 555-8001" that no letter follows, else a word without the marks around
# it. A word ends in a character that could begin one, so a text is read once.
# White space is listed: beside ``MASK``, ``\s`` makes the JVM take ten times as long.
UNIT = (
    MASK + "++"
    r"|[(+]{0,2}+[0-9]++(?:\)?[\x20.-]?\(?[0-9]++){0,5}+(?![\p{L}_@])"
    r"|[\p{L}\p{N}_](?:[^\x20\t\n\x0b\f\r\"'=:,;()<>\[\]{}|!?" + MASK + r"]*[\p{L}\p{M}\p{N}_])?"
)
# A unit can be an identifier if it has three digits, or a digit and a letter, or
# one of ``._@`` between two others. Units of fewer characters, and other words,
# only count against the patterns they stand in.
LOOKS = r"^(?:(?:[^0-9]*+[0-9]){3}|(?=[^\p{L}]*+\p{L})[^0-9]*+[0-9]|.*?[\p{L}\p{N}][._@][\p{L}\p{N}])"
MIN_CHARS = 5
# What a unit that can be an identifier has, and what a text with such a unit has.
SIGN = "[0123456789._@]"
SIGNS = r"[0123456789" + MASK + r"]|[\p{L}\p{N}][._@][\p{L}\p{N}]"
# Lengths are added up in blocks of 2**BLOCK units.
BLOCK = 6

# Trusted units that a pattern needs; score it needs; most rounds. A round without
# a new trusted unit is the last; each other one trusts one more at least.
MIN_SUPPORT = 2
MIN_SCORE = 0.5
MAX_ROUNDS = 20

# A part of the texts, one in so many, is read first for patterns without hope.
PARTS = 32
# At most so many wanted patterns are sent to every task, and so many stand in the plan.
MAX_WANTED = 100_000
MAX_LISTED = 5_000

NONE = "array<struct<start:int,end:int,match:string>>"


def _matches(text: Column, pattern: str, when: Column) -> Column:
    """``start``, ``end`` (code points, end exclusive) and ``match`` of every match.

    The text is split by the pattern; pieces and matches alternate, so their
    lengths add up to the places. Texts that cannot match are not searched.
    """

    def places(gaps: Column, found: Column) -> Column:
        ends = F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1),
            F.array().cast("array<int>"),
            lambda done, i: F.array_append(
                done,
                F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
                + F.length(F.get(gaps, i))
                + F.length(F.get(found, i)),
            ),
        )
        return bind(
            ends,
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(at, i) - F.length(m)).alias("start"), F.get(at, i).alias("end"), m.alias("match")
                ),
            ),
        )

    def search(held: Column) -> Column:
        return bind(
            F.struct(
                F.split(held, pattern, -1).alias("gaps"), F.regexp_extract_all(held, F.lit(pattern), F.lit(0)).alias("found")
            ),
            lambda both: F.when(F.size(both["found"]) > 0, places(both["gaps"], both["found"])).otherwise(
                F.array().cast(NONE)
            ),
        )

    return F.when(when, search(text)).otherwise(F.array().cast(NONE))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(digit: Column, place: Column) -> Column:
        value = F.when(place % 2 == 1, digit.cast("int") * 2).otherwise(digit.cast("int"))
        return F.when(value > 9, value - 9).otherwise(value)

    backwards = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    total = F.aggregate(F.transform(backwards, worth), F.lit(0), lambda done, v: done + v)
    return total % 10 == 0


def _is_ip(match: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _is_card(match: Column) -> Column:
    return bind(_digits(match), lambda d: F.length(d).between(12, 19) & _luhn(d))


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def base_spans(text: Column) -> Column:
    """The typed spans as (``start``, ``kind``, ``end``), in order; ``kind`` is a place in ``KINDS``.

    Leftmost non-overlapping matches of each kind; those that fail their
    kind's test are dropped.
    """
    digit = text.rlike("[0-9]")
    found = (
        (_matches(text, EMAIL, text.contains("@")), None),
        (_matches(text, IP, digit & text.contains(".")), _is_ip),
        (_matches(text, CARD, digit), _is_card),
        (_matches(text, PHONE, digit & text.contains("+")), _is_phone),
    )

    def of_kind(matches: Column, test, kind: int) -> Column:
        valid = matches if test is None else F.filter(matches, lambda m: test(m["match"]))
        return F.transform(
            valid, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        )

    return F.sort_array(F.concat(*[of_kind(m, test, kind) for kind, (m, test) in enumerate(found)]))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with the characters of the spans replaced by ``MASK``."""

    def step(at: Column, span: Column) -> Column:
        begin = F.greatest(at["end"], span["start"])
        more = F.array(F.substring(text, at["end"] + 1, begin - at["end"]), F.repeat(F.lit(MASK), span["end"] - begin))
        covered = span["end"] <= at["end"]
        return F.struct(
            F.when(covered, at["parts"]).otherwise(F.concat(at["parts"], more)).alias("parts"),
            F.greatest(at["end"], span["end"]).alias("end"),
        )

    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end"))
    masked = F.aggregate(
        spans, begin, step, lambda at: F.concat(F.array_join(at["parts"], ""), F.substring(text, at["end"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) == 0, text).otherwise(masked)


def _looks(unit: Column) -> Column:
    return (F.length(unit) >= MIN_CHARS) & unit.rlike(SIGN) & unit.rlike(LOOKS)


def _around(words: Column, at: Column) -> Column:
    """Unit ``at`` and the two before and after it."""
    near = {"before": -1, "earlier": -2, "after": 1, "later": 2}
    return F.struct(F.get(words, at).alias("unit"), *[F.get(words, at + by).alias(name) for name, by in near.items()])


def _patterns(around: Column) -> Column:
    """The patterns of a unit; those that a text's end or a masked span cuts off are null."""

    def word(name: str) -> Column:
        return F.when(~around[name].startswith(MASK), F.lower(around[name]))

    return F.array(
        F.concat(F.lit("< "), word("before")),
        F.concat(F.lit("<< "), word("earlier"), F.lit(" "), word("before")),
        F.concat(F.lit(">> "), word("after"), F.lit(" "), word("later")),
    )


def _starts(gaps: Column, words: Column, wanted: Column, use) -> Column:
    """``use(unit, start)`` for each of the ``wanted`` units, by number.

    A unit's start is the length of all before it: of whole blocks, added up
    once, and of the units of its own block.
    """
    add = lambda done, n: done + n

    def block_starts(lengths: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(lengths), BLOCK)),
            lambda b: F.aggregate(F.slice(lengths, F.shiftleft(b, BLOCK) + 1, F.lit(1 << BLOCK)), F.lit(0), add),
        )
        return F.aggregate(sums, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))

    def places(lengths: Column, blocks: Column) -> Column:
        def start(i: Column) -> Column:
            block = F.shiftright(i, BLOCK)
            own = F.slice(lengths, F.shiftleft(block, BLOCK) + 1, i.bitwiseAND((1 << BLOCK) - 1))
            return F.get(blocks, block) + F.aggregate(own, F.lit(0), add) + F.length(F.get(gaps, i))

        return F.transform(wanted, lambda i: bind(start(i), lambda at: use(i, at)))

    lengths = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
    return bind(lengths, lambda held: bind(block_starts(held), lambda blocks: places(held, blocks)))


PLACE = "array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"


def _occurrences(text: Column, masked: Column, base: Column) -> Column:
    """Seeds and units that look like identifiers: ``start``, ``end``, ``seed``, ``instance``, ``patterns``."""

    def places(words: Column, wanted: Column) -> Column:
        def place(i: Column, start: Column) -> Column:
            end = start + F.length(F.get(words, i))
            return F.struct(
                start.alias("start"),
                end.alias("end"),
                F.exists(base, lambda b: (b["start"] < end) & (b["end"] > start)).alias("seed"),
                F.lower(F.substring(text, start + 1, end - start)).alias("instance"),
                F.array_compact(bind(_around(words, i), _patterns)).alias("patterns"),
            )

        gaps = F.split(masked, UNIT, -1)
        return bind(gaps, lambda held: _starts(held, words, wanted, place))

    def search(words: Column) -> Column:
        wanted = F.array_compact(F.transform(words, lambda w, i: F.when(w.startswith(MASK) | _looks(w), i)))
        return bind(
            wanted, lambda held: F.when(F.size(held) > 0, places(words, held)).otherwise(F.array().cast(PLACE))
        )

    found = bind(F.regexp_extract_all(masked, F.lit(UNIT), F.lit(0)), search)
    # The mask's own character in a text makes neither a seed nor an identifier.
    kept = F.filter(found, lambda o: o["seed"] | ~o["instance"].startswith(MASK))
    return F.when(masked.rlike(SIGNS), kept).otherwise(F.array().cast(PLACE))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key``, ``base`` spans and ``occurrences`` per document."""
    text = text_of(text_col)
    held = docs.select(F.col(id_col).alias("id"), text.alias("held_text"))
    spotted = held.select("id", text_key("held_text").alias("text_key"), "held_text", base_spans(F.col("held_text")).alias("base"))
    hidden = spotted.withColumn("masked", _masked(F.col("held_text"), F.col("base")))
    return hidden.select(
        "id", "text_key", "base", _occurrences(F.col("held_text"), F.col("masked"), F.col("base")).alias("occurrences")
    )


def _ordinary(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """The ordinary words in each of the ``wanted`` patterns, repeats included: ``pattern``, ``instance``.

    Every unit of every text is read; a task keeps those in a wanted pattern.
    Units leave their text with their four neighbours, not with all of it, and,
    where few patterns are wanted, only those beside a word of one.
    Repeats go when the graph's edges are made, so that they meet in one shuffle.
    """
    words = F.regexp_extract_all(text_of(text_col), F.lit(UNIT), F.lit(0))
    listed = _listed(wanted)

    def near(held: Column) -> Column:
        if listed is None:
            return F.transform(held, lambda _, i: _around(held, i))
        before, after = listed
        beside = lambda lower: F.array_compact(
            F.transform(lower, lambda _, i: F.when(F.get(lower, i - 1).isin(before) | F.get(lower, i + 1).isin(after), i))
        )
        return F.transform(bind(F.transform(held, lambda word: F.lower(word)), beside), lambda i: _around(held, i))

    around = docs.select(F.explode(bind(words, near)).alias("around"))
    placed = around.filter(~_looks(F.col("around.unit"))).select(
        F.lower("around.unit").alias("instance"), F.explode(_patterns(F.col("around"))).alias("pattern")
    )
    return (
        lookup_join(placed, wanted, "pattern", "places", "instance", MAX_WANTED)
        .filter("places is not null")
        .select("pattern", "instance")
    )


def _listed(wanted: DataFrame) -> tuple[list[str], list[str]] | None:
    """The words that may stand just before, and just after, a unit in one of the ``wanted`` patterns.

    Groups of digits may hold blanks, so all that may be the nearer of two words
    are listed. None if too many patterns are wanted.
    """
    patterns = [r.pattern for r in wanted.select("pattern").limit(MAX_LISTED + 1).collect()]
    if len(patterns) > MAX_LISTED:
        return None
    before, after = set(), set()
    for side, _, words in (p.partition(" ") for p in patterns):
        cuts = [k for k, c in enumerate(words) if c == " "]
        if side == "<":
            before.add(words)
        elif side == "<<":
            before.update(words[k + 1 :] for k in cuts)
        else:
            after.update(words[:k] for k in cuts)
    return sorted(before), sorted(after)


def _hopeful(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """Those of the ``wanted`` patterns that could still become confident, with ``places``.

    A pattern with more than ``support / MIN_SCORE`` different ordinary words
    cannot reach the score, whatever its other units. Many show that in a small
    part of the texts, and their words are then not gathered from all of them.
    """
    part = docs.filter(F.pmod(F.xxhash64(text_of(text_col)), F.lit(PARTS)) == 0)
    words = _ordinary(part, wanted, text_col).groupBy("pattern", "instance").agg(F.count("*").alias("times"))
    counts = words.groupBy("pattern").agg(F.count("*").alias("words"))
    hopeful = wanted.join(counts, "pattern", "left").filter(
        F.coalesce("words", F.lit(0)) * MIN_SCORE <= F.col("support")
    )
    return written(hopeful.select("pattern", "places"))


def _reachable(edges: DataFrame) -> DataFrame:
    """Every ``pattern`` that could become confident, with its ``places`` among trusted units.

    ``support`` is the most different trusted units that it can have. The
    bootstrap without ordinary words, which can only lower a score. A round
    reads the edges of trusted units and those of the patterns beside at least
    ``MIN_SUPPORT`` of them, and no others.
    """
    trusted = written(edges.filter("seed").groupBy("instance").agg(F.count("*").alias("places")))
    known = trusted.count()
    found = None
    for _ in range(MAX_ROUNDS):
        beside = written(
            lookup_join(edges.select("pattern", "instance"), trusted, "instance", "places", "pattern")
            .filter("places is not null")
            .groupBy("pattern", "instance")
            .agg(F.count("*").alias("places"))
            .groupBy("pattern")
            .agg(F.count("*").alias("support"), F.sum("places").alias("places"))
            .filter(F.col("support") >= MIN_SUPPORT)
        )
        inside = written(
            lookup_join(edges.select("pattern", "instance"), beside, "pattern", "places", "instance")
            .filter("places is not null")
            .groupBy("pattern", "instance")
            .agg(F.count("*").alias("held"), F.max("support").alias("support"))
        )
        found = written(
            inside.groupBy("pattern")
            .agg(F.sum("held").alias("places"), F.max("support").alias("support"), F.count("*").alias("instances"))
            .filter(F.col("support") >= MIN_SCORE * F.col("instances"))
            .select("pattern", "places", "support")
        )
        more = lookup_join(inside.select("pattern", "instance", "held"), found, "pattern", "places", "instance")
        trusted = written(
            more.filter("places is not null")
            .select("instance", F.col("held").alias("places"))
            .unionByName(trusted)
            .groupBy("instance")
            .agg(F.sum("places").alias("places"))
        )
        before, known = known, trusted.count()
        if known == before:
            break
    return found


def score_patterns(occurrences: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``pattern``, ``score``, ``support`` of every pattern, from (``pattern``, ``instance``, ``seed``).

    ``support`` is the number of a pattern's different trusted instances, and
    ``score`` their share of all its different instances, or 0 if there are
    fewer than ``MIN_SUPPORT``. Seeds are trusted; other instances are as soon as
    one of their patterns scores ``MIN_SCORE``. Trust only grows, so rounds end
    when no instance is added (or after ``rounds``). If there is a column
    ``plain``, instances that have it set are never trusted. A pattern or an
    instance may have any share of the edges: edges are reduced in each task and
    meet scores by ``lookup_join``.
    """
    plain = F.max("plain") if "plain" in occurrences.columns else F.lit(False)
    edges = written(
        occurrences.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), plain.alias("plain"))
    )
    count = F.count("*").alias("patterns")
    seeds = edges.filter("seed").select("instance")
    trusted = written(seeds.groupBy("instance").agg(count))
    known = trusted.count()
    scores = None
    for _ in range(rounds):
        scores = written(
            lookup_join(edges, trusted, "instance", "patterns", "pattern")
            .groupBy("pattern")
            .agg(F.count("patterns").alias("support"), F.count("*").alias("instances"))
            .withColumn(
                "score", F.when(F.col("support") >= MIN_SUPPORT, F.col("support") / F.col("instances")).otherwise(0.0)
            )
        )
        confident = scores.filter(F.col("score") >= MIN_SCORE).select("pattern", "instances")
        inside = lookup_join(edges.filter("not plain"), confident, "pattern", "instances", "instance")
        trusted = written(
            inside.filter("instances is not null").select("instance").unionByName(seeds).groupBy("instance").agg(count)
        )
        before, known = known, trusted.count()
        if known == before:
            break
    return scores.select("pattern", "score", "support")


def confident_patterns(
    scanned: DataFrame, docs: DataFrame, text_col: str = "text"
) -> DataFrame:
    """``pattern``, ``score``, ``places`` of the patterns that name identifiers, from a ``scan`` of ``docs``."""
    edges = written(
        scanned.select(F.explode("occurrences").alias("o")).select(
            F.explode("o.patterns").alias("pattern"), "o.instance", "o.seed"
        )
    )
    wanted = _hopeful(docs, _reachable(edges), text_col)
    known = lookup_join(edges, wanted, "pattern", "places", "instance").filter("places is not null")
    ordinary = _ordinary(docs, wanted, text_col)
    graph = known.select("pattern", "instance", "seed", F.lit(False).alias("plain")).unionByName(
        ordinary.select("pattern", "instance", F.lit(False).alias("seed"), F.lit(True).alias("plain"))
    )
    return written(
        score_patterns(graph).filter(F.col("score") >= MIN_SCORE).join(wanted, "pattern").select("pattern", "score", "places")
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key``, ``base`` and all ``spans`` (``start``, ``kind``, ``end``) per document.

    Null texts are empty. Repeated rows have the same spans, a row each. An
    empty table gives an empty one; other columns are not read.
    """
    scanned = written(scan(docs, id_col, text_col))
    confident = confident_patterns(scanned, docs, text_col)
    seen = scanned.select("id", "text_key", F.explode("occurrences").alias("o")).filter("not o.seed")
    placed = seen.select("id", "text_key", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    named = lookup_join(placed, confident, "pattern", "places", "text_key").filter("score is not null")
    more = named.groupBy(F.col("id").alias("more_id"), F.col("text_key").alias("more_key")).agg(
        F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("more")
    )
    return scanned.select("id", "text_key", "base").join(
        more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")), "left"
    ).select(
        "id",
        "text_key",
        "base",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))).alias("spans"),
    )


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans, per document; see ``find_spans``."""
    found = find_spans(docs, id_col, text_col)
    count = lambda kind, spans: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        *[count(n, "base").alias(f"n_{kind}") for n, kind in enumerate(KINDS[:4])],
        count(4, "spans").alias("n_id"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by its first kind's name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(at: Column, span: Column) -> Column:
        inside = span["start"] < at["end"]
        parts = F.when(inside, at["parts"]).otherwise(
            F.concat(
                at["parts"],
                F.array(F.substring(text, at["end"] + 1, span["start"] - at["end"]), F.get(names, span["kind"])),
            )
        )
        return F.struct(parts.alias("parts"), F.greatest(at["end"], span["end"]).alias("end"))

    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end"))
    return F.aggregate(
        spans, begin, step, lambda at: F.concat(F.array_join(at["parts"], ""), F.substring(text, at["end"] + 1, F.length(text)))
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with every span replaced by its kind in brackets.

    Only documents with a span are looked up; the others, null texts among
    them, stay as they are.
    """
    found = (
        find_spans(docs, id_col, text_col)
        .filter(F.size("spans") > 0)
        .groupBy(F.col("id").alias("found_id"), F.col("text_key").alias("found_key"))
        .agg(F.first("spans").alias("found_spans"))
    )
    text = F.col("row")[text_col]
    return (
        whole_rows(docs, id_col, text_col)
        .join(found, F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key")), "left")
        .select(
            F.when(F.col("found_spans").isNull(), F.col("row"))
            .otherwise(F.col("row").withField(f"`{text_col}`", _redacted(text, F.col("found_spans"))))
            .alias("row")
        )
        .select("row.*")
    )
