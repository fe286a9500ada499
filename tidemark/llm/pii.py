"""Personal data: strict formats, and looser candidates that boosted trees accept or refuse.

Base spans come from four strict patterns with their checks (octets of an
address, the Luhn sum of a card, the digits of a phone number).  High-recall
generators propose looser, overlapping spans: numbers with any separators, mail
addresses with spelled-out or spaced signs, and long tokens that may be secrets.
Gradient-boosted trees score them by format and context.

Labels.  Positive are base spans in disguise: as they stand, and written as they
are not allowed to be (without the plus sign or the country code, with other
separators, with spelled-out signs), so that what the trees accept is not what
the strict patterns find anyhow.  Negative are what a strict pattern matches and
its check refuses, disguised likewise, and numbers glued to letters.  All other
candidates are unlabelled: they count as negative with the weight ``doubt``, as
most of them are, though some are what is looked for.  A token is positive if it
has the format of a key (hexadecimal of usual length, or letters of both cases
and digits) and is assigned to something, else negative.

Features are discrete, so the training data are counts of feature combinations;
boosting runs on that table and its trees become a column expression.  Trees are
fitted on a sample of texts; the threshold of each generator is the least score
at which the calibrated share of positives reaches ``precision`` over a fifth of
all texts, which the trees have not seen; without ``least_seen`` of them above it
nothing is added.

Every step is a DataFrame function over single rows; nothing is shuffled but
the counts.  Patterns are written with possessive quantifiers, which match the
same spans as greedy ones here but neither recurse nor backtrack on long runs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import sampled

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans with those that only the model finds.
ALL_KINDS = (*KINDS, "secret")

#: \G lets a match start where the last one ended, inside a run of its first character class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any match has, so that other texts skip the pattern.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][0-9\x20-][0-9]",
    "phone": r"\+[0-9]",
    "mail": "@|(?i:[(\\[]at[)\\]])",
    "number": r"[0-9][0-9().\x20/-]{3}",
    "token": r"[A-Za-z0-9_/+-]{20}",
}

GENERATORS = {
    "mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+(?:@|(?i:[(\[]at[)\]]))\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|(?i:[(\[]dot[)\]]))\x20?+[A-Za-z0-9-]++)*+",
    "number": r"[+(]?+[0-9](?:[().\x20/-]{0,2}+[0-9]){6,}+",
    "token": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CONTEXT = {
    1: r"(?i)(?:tel|phone|call|fax|mobile|cell)[^0-9\n]{0,12}$",
    2: r"(?i)(?:mail|contact|write|reach)[^\n]{0,12}$",
    3: r"(?i)(?:ssn|card|account|iban|passport|visa)[^0-9\n]{0,12}$",
    4: r"(?i)(?:page|version|order|isbn|issn|no\.|nr\.|vol\.|date)[^0-9\n]{0,12}$",
    5: r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|auth|credential)[^\n]{0,6}$",
}
_ASSIGNED = "[:=]\\s*[\"'`]?$"
_KEY_FORMAT = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{24,})$"
#: Discrete features and their numbers of values; those that a generator has no use for are 0.
FEATURES = {"generator": 3, "plus": 2, "digits": 6, "groups": 4, "separator": 6, "parens": 2, "check": 3, "context": 6, "at": 3, "dots": 2, "glued": 2, "assigned": 2, "charset": 4}


def _empty_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string>>")


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), in code points.

    Positions are sums of the lengths of matches and of the parts between them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(between) - 1), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), _empty_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        end = first + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(first.alias("start"), end.alias("end"), x["m"].alias("match"))).alias("out"))

    return F.when(text.rlike(needs), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(_empty_spans())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    place = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(place, F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _accepted(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["match"]))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the array of its base spans (start, end, match)."""
    return {kind: _accepted(kind, spans_of(text, BASE[kind], NEEDS[kind])) for kind in KINDS}


def _refused(kind: str, spans: Column) -> Column:
    """Those of a strict pattern's matches that fail its check; of cards only the sum of 16 to 19 digits counts."""
    long = (lambda s: F.length(_digits(s["match"])).between(16, 19)) if kind == "card" else (lambda s: F.lit(True))
    return F.filter(spans, lambda s: long(s) & ~_valid(kind, s["match"]))


def _code(text: Column, generator: str, start: Column, end: Column, m: Column) -> Column:
    """The features of the text m, standing at start to end, as one number."""
    before = F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
    after = F.substring(text, end + 1, F.lit(1))
    digits = _digits(m)
    n = F.length(digits)
    values = {"generator": F.lit([*GENERATORS].index(generator)), "context": reduce(lambda rest, k: F.when(before.rlike(_CONTEXT[k]), k).otherwise(rest), reversed(_CONTEXT), F.lit(0))}
    if generator == "mail":
        values["at"] = F.when(m.contains("@"), 1).when(m.rlike(r"(?i)[(\[]at[)\]]"), 2).otherwise(0)
        values["dots"] = m.rlike(r"(?i)(?:@|at[)\]]).*(?:\.|[(\[]dot[)\]])").cast("int")
    elif generator == "number":
        between = F.array_distinct(F.regexp_extract_all(m, F.lit("[^0-9+()]"), 0))
        separator = reduce(lambda rest, k: F.when(between[0] == k[1], k[0]).otherwise(rest), enumerate(".-/ ", 1), F.lit(0))
        groups = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), 0))
        values |= {
            "plus": m.startswith("+").cast("int"),
            "digits": F.when(n < 9, 0).when(n < 10, 1).when(n < 12, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5),
            "groups": F.when(groups == 1, 0).when(groups == 2, 1).when(groups == 3, 2).otherwise(3),
            "separator": F.when(F.size(between) == 0, 0).when(F.size(between) > 1, 5).otherwise(separator),
            "parens": m.rlike(r"[()]").cast("int"),
            "check": F.when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), 2).when(n.between(16, 19), F.when(luhn(digits), 1).otherwise(0)).otherwise(0),
            "glued": (before.rlike("[A-Za-z0-9_@.,/+-]$") | after.rlike("[A-Za-z0-9_@]")).cast("int"),
        }
    else:
        values |= {
            "digits": F.when(n == 0, 0).when(n < 4, 1).when(n < 8, 2).when(n < 16, 3).when(n < 32, 4).otherwise(5),
            "assigned": before.rlike(_ASSIGNED).cast("int"),
            "charset": F.when(m.rlike("^[0-9]+$"), 0).when(n == 0, 1).when(m.rlike("^[0-9a-fA-F]+$"), 2).otherwise(3),
        }
    code = F.lit(0)
    for name, size in FEATURES.items():
        code = code * size + values.get(name, F.lit(0))
    return code.cast("int")


def _decode(code: int) -> dict[str, int]:
    out = {}
    for name, size in reversed(FEATURES.items()):
        code, out[name] = divmod(code, size)
    return out


def candidates(text: Column) -> Column:
    """Proposed spans (start, end, match, generator, code) of all generators; those of different ones may overlap."""

    def proposed(name: str) -> Column:
        whole = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.lit(name).alias("generator"), _code(text, name, s["start"], s["end"], s["match"]).alias("code"))
        return F.transform(spans_of(text, GENERATORS[name], NEEDS[name]), whole)

    return F.concat(*map(proposed, GENERATORS))


def disguises(m: Column, kind: str) -> Column:
    """A span of a kind as it stands, and as strict patterns don't take it."""
    if kind == "email":
        name, _, host = F.split_part(m, F.lit("@"), F.lit(1)), None, F.split_part(m, F.lit("@"), F.lit(2))
        spelled = [F.concat(name, F.lit(at), F.regexp_replace(host, r"\.", dot)) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."))]
        return F.array(m, *spelled)
    if kind == "card":
        fours = F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", "$1 ")
        return F.array(m, *[F.translate(fours, " ", sign) for sign in "/."])
    if kind == "phone":
        local = F.regexp_replace(m, r"^\+[0-9]+[\x20().-]*", "")
        local = F.when(m.rlike(r"^\+[0-9]+[\x20.-]*\("), F.concat(F.lit("("), local)).otherwise(local)
        bare = F.trim(F.regexp_replace(local, "[^0-9]+", " "))
        return F.filter(F.array(m, F.substring(m, 2, 1 << 20), local, *[F.translate(bare, " ", sign) for sign in "-. "]), lambda v: F.length(_digits(v)) >= 7)
    return F.array(m)


def _labelled(text: Column, base: dict[str, Column], refused: dict[str, Column]) -> Column:
    """Codes with labels: an array of (code, positive, negative) over all candidates; unlabelled ones have neither."""
    row = lambda code, y: F.struct(code.alias("code"), (y == 1).cast("int").alias("positive"), (y == 0).cast("int").alias("negative"))
    known, rows = [(1, base), (0, refused)], []

    def disguised(kind: str, found: Column, y: int) -> Column:
        generator = "mail" if kind == "email" else "number"
        return F.flatten(F.transform(found, lambda s: F.transform(disguises(s["match"], kind), lambda v: row(_code(text, generator, s["start"], s["end"], v), F.lit(y)))))

    for y, spans in known:
        rows += [disguised(kind, found, y) for kind, found in spans.items()]
    taken = F.concat(*[found for _, spans in known for found in spans.values()])

    def free(name: str) -> Column:
        found = F.filter(spans_of(text, GENERATORS[name], NEEDS[name]), lambda c: ~F.exists(taken, lambda s: _overlaps(s, c)))

        def label(c: Column) -> Column:
            before = F.substring(text, F.greatest(c["start"] - 3, F.lit(1)), F.least(c["start"], F.lit(4)))
            if name == "token":
                return F.when(c["match"].rlike(_KEY_FORMAT) & before.rlike(_ASSIGNED), 1).otherwise(0)
            glued = before.rlike("[A-Za-z_]$") | F.substring(text, c["end"] + 1, F.lit(1)).rlike("[A-Za-z_]")
            return F.when(glued, 0).otherwise(-1) if name == "number" else F.lit(-1)

        return F.transform(found, lambda c: row(_code(text, name, c["start"], c["end"], c["match"]), label(c)))

    return F.concat(*rows, *map(free, GENERATORS))


def boost(cells: list[tuple[int, float, float]], rounds: int = 40, rate: float = 0.3, depth: int = 3) -> tuple[float, list]:
    """Gradient boosting (logistic loss) on (code, rows, positive rows): prior log-odds and trees.

    A tree is a leaf value or (feature, value, tree if feature <= value, tree if not).
    """
    rows = [(_decode(code), n, pos) for code, n, pos in cells if n > 0]
    total, positive = sum(n for _, n, _ in rows), sum(p for _, _, p in rows)
    if not total:
        return 0.0, []
    prior = math.log((positive + 0.5) / (total - positive + 0.5))
    scores, trees = [prior] * len(rows), []

    def grow(at: list[int], left: int, grads: list[tuple[float, float]]):
        g, h = sum(grads[i][0] for i in at), sum(grads[i][1] for i in at)
        leaf = rate * g / (h + 1.0)
        best = None
        for name, size in FEATURES.items() if left else ():
            for value in range(size - 1):
                low = [i for i in at if rows[i][0][name] <= value]
                if 0 < len(low) < len(at):
                    gl, hl = sum(grads[i][0] for i in low), sum(grads[i][1] for i in low)
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, name, value, set(low))
        if best is None:
            return leaf
        _, name, value, low = best
        return (name, value, grow([i for i in at if i in low], left - 1, grads), grow([i for i in at if i not in low], left - 1, grads))

    for _ in range(rounds):
        grads = []
        for (_, n, pos), s in zip(rows, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            grads.append((pos - n * p, n * p * (1 - p)))
        tree = grow(list(range(len(rows))), depth, grads)
        trees.append(tree)
        scores = [s + _leaf(tree, features) for s, (features, _, _) in zip(scores, rows, strict=True)]
    return prior, trees


def _leaf(tree, features: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def score(prior: float, trees: list, code: int) -> float:
    return prior + sum(_leaf(t, _decode(code)) for t in trees)


def _score_column(prior: float, trees: list, code: Column) -> Column:
    """The same score as a column of the trees' conditions."""
    sizes = list(FEATURES.items())

    def feature(name: str) -> Column:
        at = [k for k, _ in sizes].index(name)
        after = math.prod(s for _, s in sizes[at + 1 :])
        return F.floor(code / after) % sizes[at][1]

    def column(tree) -> Column:
        return F.lit(float(tree)) if not isinstance(tree, tuple) else F.when(feature(tree[0]) <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    return reduce(lambda a, t: a + column(t), trees, F.lit(prior))


class Model:
    """Trees and the threshold of each generator (infinite: nothing is added)."""

    def __init__(self, prior: float, trees: list, thresholds: dict[str, float]):
        self.prior, self.trees, self.thresholds = prior, trees, thresholds

    def accepts(self, candidate: Column) -> Column:
        limit = reduce(lambda rest, g: F.when(candidate["generator"] == g, F.lit(self.thresholds[g])).otherwise(rest), self.thresholds, F.lit(math.inf))
        return _score_column(self.prior, self.trees, candidate["code"]) >= limit


def calibrate(prior: float, trees: list, cells: list[tuple[int, float, float]], precision: float, least_seen: int) -> dict[str, float]:
    """For each generator, the least score from which on candidates are positive often enough.

    The share of positives as a function of the score is made monotone first
    (isotonic regression by pooling neighbours), so that a threshold says what
    is true of the candidates beside it, not of all above it.
    """
    out = {}
    for g, name in enumerate(GENERATORS):
        own = sorted((score(prior, trees, c), n, pos) for c, n, pos in cells if _decode(c)["generator"] == g and n > 0)
        blocks: list[list[float]] = []
        for value, n, pos in own:
            blocks.append([value, n, pos])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                _, n, pos = blocks.pop()
                blocks[-1][1:] = [blocks[-1][1] + n, blocks[-1][2] + pos]
        good = [b for b in blocks if b[2] >= precision * b[1]]
        # a little lower, as sums of leaves may be added in another order
        out[name] = good[0][0] - 1e-9 if sum(b[1] for b in good) >= least_seen else math.inf
    return out


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 50_000, precision: float = 0.9, least_seen: int = 20, doubt: float = 0.1, id_col: str = "doc_id", seed: int = 7) -> Model:
    """Learn from about ``max_docs`` whole texts (picked by a hash of id and text); a fifth of all texts sets the thresholds."""
    share = min(1.0, max_docs / max(1, docs.count()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # copies of one text are on one side
    rows = docs.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("held"), sampled(F.lit(share), seed, F.col(id_col), F.col(text_col)).alias("picked"))
    rows = rows.filter("held OR picked").withColumns({f"_{k}": spans_of(F.col("text"), BASE[k], NEEDS[k]) for k in KINDS})
    rows = rows.withColumns({f"_base_{k}": _accepted(k, F.col(f"_{k}")) for k in KINDS} | {f"_refused_{k}": _refused(k, F.col(f"_{k}")) for k in KINDS})
    base, refused = ({k: F.col(f"_{side}_{k}") for k in KINDS} for side in ("base", "refused"))
    labelled = rows.select("held", F.explode(_labelled(F.col("text"), base, refused)).alias("c"))
    counted = labelled.groupBy("held", "c.code").agg(F.count("*").alias("n"), F.sum("c.positive").alias("pos"), F.sum("c.negative").alias("neg"))
    # a row for each side and combination of features
    cells = [(r["held"], r["code"], float(r["pos"]), r["pos"] + r["neg"] + doubt * (r["n"] - r["pos"] - r["neg"])) for r in counted.collect()]
    learn, held = ([(code, weight, pos) for side, code, pos, weight in cells if side == held] for held in (False, True))
    prior, trees = boost(sorted(learn))
    return Model(prior, trees, calibrate(prior, trees, held, precision, least_seen))


def find(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (order, kind, start, end) sorted by kind as in ALL_KINDS, then start.

    ``spans`` has all base spans and what the model adds beside them; of added
    spans that overlap, the one that starts first stays.  A null text counts as
    empty.  Columns of docs named base or spans are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumns({f"_{kind}": spans for kind, spans in base_spans(F.col("_text")).items()})
    named = lambda s, order, kind: F.struct(order.alias("order"), kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def named_base(at: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: named(s, F.lit(at), F.lit(kind)))

    base = F.concat(*[named_base(at, kind) for at, kind in enumerate(KINDS)])
    out = out.withColumns({"base": base, "_proposed": candidates(F.col("_text"))})

    def named_candidate(c: Column) -> Column:
        n = F.length(_digits(c["match"]))
        order = F.when(c["generator"] == "mail", 0).when(c["generator"] == "token", 4).when(c["match"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1).when(n >= 16, 2).otherwise(3)
        return named(c, order, F.element_at(F.array(*map(F.lit, ALL_KINDS)), order + 1))

    fresh = F.filter("_proposed", lambda c: ~F.exists("base", lambda b: _overlaps(b, c)) & model.accepts(c))
    ordered = F.array_sort(F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), named_candidate(c).alias("span"))))
    none = F.array().cast("array<struct<order:int,kind:string,start:int,end:int>>")
    added = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, c: F.when(c["start"] < acc["at"], acc).otherwise(F.struct(c["span"]["end"].alias("at"), F.array_append(acc["out"], c["span"]).alias("out"))),
        lambda acc: acc["out"],
    )
    out = out.withColumn("spans", F.array_sort(F.concat("base", added)))
    return out.drop("_text", "_proposed", *[f"_{k}" for k in KINDS])


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (of any kind, overlapping ones as one) replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        part = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], part).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
