"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Every pattern starts at a place that a look-behind fixes, and its loops
are possessive, so that a scan takes time in proportion to the text. Offsets are running sums taken
in steps of STEP, and contexts come from the matches and gaps around a match, so that neither goes
through the text again for each span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bound

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"
#: Elements that a running value goes through at once; a step begins from the value before it.
STEP = 32
#: Spans for which a long text is cut once before they are taken out of the part.
CUT = 256
#: Every match has two characters at least, so that so many matches on either side hold the context.
SHORTEST = 2


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True where the digits of match pass the Luhn check."""

    def step(acc: Column, digit: Column, i: Column) -> Column:
        value = digit.cast("int") * (1 + i % 2)
        return acc + value - F.when(value > 9, 9).otherwise(0)

    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    total = F.aggregate(F.filter(digits, lambda e: e["d"] != ""), F.lit(0), lambda acc, e: step(acc, e["d"], e["i"]))
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """True where an account number leaves 1 when its rearranged digits are divided by 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")
    left = F.aggregate(
        signs,
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.when(c.rlike("[0-9]"), c).otherwise("0").cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return left == 1


def octets(match: Column) -> Column:
    """True where all dotted parts are at most 255."""
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def n_digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(_digits(match)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """A kind of span. base kinds stay whatever their score; others need the operator's min_score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = False


#: In the order in which spans with one start are listed.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        0.9,
        r"(?i)(e-?mail|contact|write to|mailto)",
        True,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.6, r"(?i)(\bip\b|address|host|server)", True),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda m: n_digits(14, 19)(m) & luhn(m),
        0.9,
        r"(?i)(card|visa|master|amex|payment|credit)",
        True,
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", n_digits(10, 15), 0.7, r"(?i)(phone|tel|call|mobile|fax)", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod97, 0.9, r"(?i)(iban|account|bank)"),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$"),
        0.6,
        r"(?i)(ssn|social security)",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])",
        lambda m: F.lit(True),
        0.4,
        r"(?i)(phone|tel|call|mobile|fax)",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_])(?i:(?:api[_-]?)?key|token|secret|passw(?:or)?d)[\"']? ?[:=] ?[\"']?[A-Za-z0-9+/_-]{16,}+",
        lambda m: m.rlike("[0-9]"),
        0.7,
        r"(?i)(credential|auth|private)",
    ),
)


def _lead(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each STEP of values, a bound column, what all values before it come to under join."""
    steps = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))
    sums = F.transform(steps, lambda k: F.aggregate(F.slice(values, k * STEP + 1, F.lit(STEP)), zero, join))
    return F.aggregate(
        sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    )


def _before(values: Column, lead: Column, i: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What the values before place i (from 0) come to; lead is _lead() of them."""
    step = F.floor(i / STEP).cast("int")
    return F.aggregate(F.slice(values, step * STEP + 1, i - step * STEP), F.get(lead, step), join)


def _sum(acc: Column, x: Column) -> Column:
    return acc + x


def _larger(acc: Column, x: Column) -> Column:
    return F.greatest(acc, x)


def _spans(text: Column, kind: Kind, order: int, window: int, bonus: float) -> Column:
    """Confirmed spans of one kind. The text between matches gives the offsets; the context is what
    stands within `window` characters on either side, other matches included."""
    pieces = F.split(text, kind.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    zero, reach = F.lit(0), window // SHORTEST + 1

    def placed(e: Column) -> Column:
        """Of e (gaps, hits): confirmed hits with place, start and both contexts."""
        gaps, hits = e["gaps"], e["hits"]
        both = F.transform(hits, lambda h, i: F.concat(F.get(gaps, i), h))
        sizes = F.transform(both, lambda x: F.length(x))
        ends = F.transform(both, lambda x: F.right(x, F.lit(window)))
        fronts = F.transform(hits, lambda h, i: F.left(F.concat(h, F.left(F.get(gaps, i + 1), F.lit(window))), F.lit(window)))
        prepared = F.struct(gaps.alias("gaps"), hits.alias("hits"), sizes.alias("sizes"), ends.alias("ends"), fronts.alias("fronts"))
        return bound(prepared, lambda x: bound(_lead(x["sizes"], zero, _sum), lambda lead: spans(x, lead)))

    def spans(e: Column, lead: Column) -> Column:
        def one(x: Column) -> Column:
            i, hit = x["i"], x["hit"]
            gap = F.get(e["gaps"], i)
            first = F.greatest(i - reach, zero)
            left = F.right(F.concat(F.array_join(F.slice(e["ends"], first + 1, i - first), ""), F.right(gap, F.lit(window))), F.lit(window))
            after = F.array_join(F.slice(e["fronts"], i + 2, F.lit(reach)), "")
            right = F.left(F.concat(F.left(F.get(e["gaps"], i + 1), F.lit(window)), after), F.lit(window))
            near = left.rlike(kind.context) | right.rlike(kind.context)
            score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(bonus)).otherwise(F.lit(0.0)))
            start = (_before(e["sizes"], lead, i, zero, _sum) + F.length(gap)).cast("int")
            return bound(
                F.struct(start.alias("start"), F.length(hit).alias("n"), F.round(score, 6).alias("score")),
                lambda s: F.struct(
                    s["start"].alias("start"), F.lit(order).alias("ord"), (s["start"] + s["n"]).alias("end"), F.lit(kind.name).alias("kind"), s["score"].alias("score")
                ),
            )

        numbered = F.transform(e["hits"], lambda h, i: F.struct(i.alias("i"), h.alias("hit")))
        return F.transform(F.filter(numbered, lambda x: kind.valid(x["hit"])), one)

    empty = F.array().cast(SPAN)
    found = bound(F.struct(pieces.alias("gaps"), hits.alias("hits")), placed)
    return F.when(text.rlike(kind.pattern), found).otherwise(empty)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_score: float = 0.6,
    context_chars: int = 40,
    context_bonus: float = 0.2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: the id, found (all spans by start, then kind: start and exclusive end in
    code points, kind, score) and the columns named in keep.

    Base kinds (email, ip, card, phone) need their validator only; the others also min_score, which
    a context word within context_chars before or after the match raises by context_bonus. Null text
    counts as empty. Spans of different kinds may overlap; of one kind they never do. Null ids pass through, repeated rows give equal rows, an empty table an empty result;
    other columns are not read unless kept.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *keep)
    each = [_spans(F.col("__text"), k, i, context_chars, context_bonus).alias(f"__k{i}") for i, k in enumerate(KINDS)]
    spans = base.select("__id", "__text", *keep, *each)
    good = [
        F.col(f"__k{i}") if k.base else F.filter(f"__k{i}", lambda s: s["score"] >= min_score) for i, k in enumerate(KINDS)
    ]
    return spans.select(F.col("__id"), "__text", *keep, F.array_sort(F.concat(*good)).alias("__found"))


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and scores (of the spans, in
    their order) of find_pii(), which says what becomes of nulls, repeated rows and empty tables."""
    found = find_pii(docs, **options)
    base = [k.name for k in KINDS if k.base]

    def count(name: str) -> Column:
        return F.size(F.filter("__found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(name) for name in base]
    return found.select(
        F.col("__id").alias("doc_id"),
        *counts,
        F.sha2(_listed(F.filter("__found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(F.col("__found")).alias("spans"),
        F.size("__found").cast("long").alias("n_spans"),
        F.array_join(F.transform("__found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _merged(spans: Column) -> Column:
    """Overlapping spans, in order of start, as one, named by the first."""
    zero = F.lit(0)

    def heads(e: Column) -> Column:
        """Spans that begin at or behind the end of all before them, with their places."""
        until = lambda i: _before(e["ends"], e["lead"], i, zero, _larger)
        first = F.filter(
            F.transform(e["spans"], lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind"), until(i).alias("until"))),
            lambda x: x["start"] >= x["until"],
        )
        return bound(
            F.struct(first.alias("h"), F.array_max(e["ends"]).alias("last")),
            lambda x: F.transform(
                x["h"], lambda s, j: F.struct(s["start"].alias("start"), F.coalesce(F.get(x["h"], j + 1)["until"], x["last"]).alias("end"), s["kind"].alias("kind"))
            ),
        )

    ends = F.transform(spans, lambda s: s["end"])
    found = bound(
        F.struct(spans.alias("spans"), ends.alias("ends")),
        lambda x: bound(F.struct(x["spans"].alias("spans"), x["ends"].alias("ends"), _lead(x["ends"], zero, _larger).alias("lead")), heads),
    )
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span of find_pii() replaced by its kind in angle brackets; all rows and columns
    stay in place, null text stays null, and other columns are untouched. Overlapping spans become one,
    named by the first. Repeated rows are masked alike; an empty table gives an empty one."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    packed = packed.select("__row", F.col("__row")[id_col].alias("__i"), F.col("__row")[text_col].alias("__t"))
    found = find_pii(packed, "__i", "__t", keep=("__row",), **options)
    merged = found.select("__row", "__text", _merged(F.col("__found")).alias("__m"))
    text = F.col("__text")

    def rebuilt(m: Column) -> Column:
        # the text is cut once for every CUT spans, and those parts once for every span
        upto = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0))

        def part(k: Column) -> Column:
            own = F.slice(m, k * CUT + 1, F.lit(CUT))
            first = upto(k * CUT)
            block = F.substring(text, first + 1, F.element_at(own, -1)["end"] - first)
            return bound(
                F.struct(own.alias("own"), first.alias("first"), block.alias("block")),
                lambda e: F.array_join(
                    F.transform(
                        e["own"],
                        lambda s, i: bound(
                            F.when(i > 0, F.get(e["own"], i - 1)["end"]).otherwise(e["first"]),
                            lambda at: F.concat(F.substring(e["block"], at - e["first"] + 1, s["start"] - at), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
                        ),
                    ),
                    "",
                ),
            )

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CUT).cast("int")), part)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))

    masked = F.when(F.size("__m") == 0, F.col("__row")[text_col]).otherwise(rebuilt(F.col("__m")))
    return merged.select(*[(masked if c == text_col else F.col("__row")[c]).alias(c) for c in names])
