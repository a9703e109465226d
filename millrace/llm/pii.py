"""Personal data in text (DataFrame operations only): patterns propose, checksums confirm, nearby words adjust a score.

The patterns are anchored to the start of their run of characters (or to the last match's end) and possessive, which gives
the same leftmost matches as the plain ones in linear time; that of ibans is not possessive but has as many characters as the
country's numbers have. Positions come from the lengths of what lies between matches,
summed in two levels, so a text with very many matches costs no more than a little over its length.

Kinds: email, ip, card, phone are the base ones and always stay. Added: iban (mod-97), ssn and secret, which are reported
where their score reaches `least_score`; a context word within 40 characters of the text before or after a span raises its
score. What the windows hold of neighbouring matches comes from a fixed number of them, as each has two characters or more.

Defined results: null counts as empty, without spans; ends are exclusive, in code points. Spans of different kinds may
overlap; of spans that start together the kind listed first comes first. Repeated rows give equal rows, no rows give none. Only
the columns named are read (masked() keeps all others as they are), so they may have any name. A very long text is one value,
with its pieces between matches beside it. A context word raises a score and never lowers one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,place:int,kind:string,end:bigint,score:double>>"
CONTEXT_CHARS = 40
#: So many matches before or after a span, of two characters or more each, fill a window.
CONTEXT_MATCHES = CONTEXT_CHARS // 2


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    raised: float
    base: bool = False
    #: For what follows a span, where it isn't the same.
    context_after: str | None = None


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _between(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number, first four characters moved to its end and letters read as 10 to 35, leaves 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _in_octets(value: Column) -> Column:
    part = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(value: Column) -> Column:
    return F.when(_between(value, 14, 19), luhn(_digits(value))).otherwise(False)


#: Characters of an account number after its country and check digits, by country: the registered ones and those in use.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FO GL NL SD FK", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN",
    17: "CH HR LI LV", 18: "CR BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ TL OM SO",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "PT ST LY AO CV GW MZ", 22: "IS TR IR DZ", 23: "FR GR IT MC MR SM CM CF TD KM CG DJ GA GQ MG BI",
    24: "AL AZ BY CY DO GT HU LB NI PL SV BF BJ CI HN MA ML NE SN TG", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}


def _iban_pattern() -> str:
    """A number of its country's length with spaces anywhere; of unlisted countries, one without spaces or in groups of four."""
    listed = "|".join(IBAN_REST[n].replace(" ", "|") for n in sorted(IBAN_REST))
    by_length = "|".join(f"(?:{IBAN_REST[n].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n in sorted(IBAN_REST))
    group = f" (?!(?:{listed})[0-9]{{2}})[A-Z0-9]"
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:{group}{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{by_length}|{other})(?![A-Za-z0-9])"


def _iban(value: Column) -> Column:
    account = F.regexp_replace(value, " ", "")
    return F.when(F.length(account).between(15, 34), mod_97(account)).otherwise(False)


KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.9, r"e-?mail|mailto|contact|write", 1.0, True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", _in_octets, 0.6, r"\bip\b|host|server|address|addr", 0.9, True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card, 0.8, r"card|visa|master|amex|credit|debit|karte|carte|tarjeta", 1.0, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: _between(v, 10, 15), 0.7, r"phone|\btel|call|mobile|fax", 0.95, True),
    Kind("iban", _iban_pattern(), _iban, 0.9, r"iban|account|konto|compte|cuenta", 1.0),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), 0.4, r"ssn|social security", 0.85),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,128}|[A-Fa-f0-9]{16,31})(?![A-Za-z0-9])", lambda v: v.rlike("[0-9]") & v.rlike("[A-Fa-f]"), 0.4, r"(?:token|password|passwd|secret|api_?key|key)\W{0,6}$", 0.9, context_after=r"^\W{0,6}(?:token|password|passwd|secret|api_?key|key)\b"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(steps: Column) -> Column:
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(steps, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"] + x)).alias("out"), (a["sum"] + x).alias("sum")))["out"]


def running_sums(steps: Column, block: int = 64) -> Column:
    """Running sums of a non-empty array of bigints, within blocks and then over blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, block))

    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return let(_sums(totals), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(_sums(p), lambda x: x + F.when(i > 0, ends[i - 1]).otherwise(0)))))

    return let(blocks, over)


def kind_spans(text: Column, kind: Kind, place: int, least_score: float) -> Column:
    """The spans of one kind, as SPAN."""
    width = F.lit(CONTEXT_CHARS)

    def located(found: Column) -> Column:
        between = F.transform(F.split(text, kind.pattern, -1), lambda p: F.struct(F.char_length(p).cast("bigint").alias("n"), F.right(p, width).alias("last"), F.left(p, width).alias("first")))

        def ended(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: gaps[i]["n"] + F.char_length(m))
            return let(running_sums(steps), lambda ends: F.transform(found, lambda m, i: span(m, ends[i], before(gaps, i), after(gaps, i))))

        return let(between, ended)

    def before(gaps: Column, i: Column) -> Column:
        start = F.greatest(i - CONTEXT_MATCHES, F.lit(0))
        parts = F.zip_with(F.slice(gaps, start + 1, i - start), F.slice(found, start + 1, i - start), lambda g, m: F.concat(g["last"], F.right(m, width)))
        return F.when((gaps[i]["n"] >= CONTEXT_CHARS) | (i == 0), gaps[i]["last"]).otherwise(F.right(F.concat(F.array_join(parts, ""), gaps[i]["last"]), width))

    def after(gaps: Column, i: Column) -> Column:
        n = F.least(F.size(found) - i - 1, F.lit(CONTEXT_MATCHES))
        parts = F.zip_with(F.slice(found, i + 2, n), F.slice(gaps, i + 3, n), lambda m, g: F.concat(F.left(m, width), g["first"]))
        return F.when((gaps[i + 1]["n"] >= CONTEXT_CHARS) | (n == 0), gaps[i + 1]["first"]).otherwise(F.left(F.concat(gaps[i + 1]["first"], F.array_join(parts, "")), width))

    def span(value: Column, end: Column, behind: Column, ahead: Column) -> Column:
        met = F.lower(behind).rlike(kind.context) | F.lower(ahead).rlike(kind.context_after or kind.context)
        score = F.when(met, kind.raised).otherwise(kind.score)
        kept = kind.confirm(value) if kind.base else kind.confirm(value) & (score >= least_score)
        return F.when(kept, F.struct((end - F.char_length(value)).alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score")))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(F.filter(located(m), lambda s: s.isNotNull()).cast(SPAN)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """(doc_id, spans SPAN by start, then kind as listed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = F.concat(*(kind_spans(text, kind, k, least_score) for k, kind in enumerate(KINDS)))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.array_sort(every).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of overlapping spans the earlier one counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = F.array_sort(F.concat(*(kind_spans(text, kind, k, least_score) for k, kind in enumerate(KINDS))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        taken = F.struct(F.concat(a["out"], F.array(piece, F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < a["at"], a).otherwise(taken)

    done = let(F.aggregate(every, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def op4_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["place"] < sum(k.base for k in KINDS))
    counts = [F.size(F.filter("spans", _of_kind(kind.name))).cast("bigint").alias(f"n_{kind.name}") for kind in KINDS if kind.base]
    return find_spans(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
