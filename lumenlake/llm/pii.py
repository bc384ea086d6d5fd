"""PII scan: patterns propose spans, checksums confirm them, context words move the score.

Everything runs as Catalyst expressions in the scan stage; there is no shuffle and no
Python on the executors.

Defined results: a null text is empty; an empty text has no spans; repeated rows are
scanned each on their own; an empty table gives an empty result; other columns of the
input are ignored, so their names cannot clash. Very long texts are scanned whole; spans of
different kinds at one place are each reported, in the order of the kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.spans import flat, let, matches

#: Possessive forms of the contract's patterns: same matches, no backtracking and no deep recursion.
#: Look-behinds skip starts inside a run, which can only fail; ``\\G`` allows a start at the last match's end.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Only the start of an IBAN is matched; where it ends is for its country's length and the checksum to say.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"^(?:\x20?[A-Z0-9]){11,30}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$"

#: Letters and digits of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: 30 characters with a space before each, one character beyond, and the context.
IBAN_WINDOW = 112

#: Order of kinds, score before context, words that raise it.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
DECOY = r"(?i)\b(?:example|sample|dummy|test|fake)\b"
CONTEXT_CHARS = 48
ADDED_SCORE = 0.6


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """True where the digits of ``m`` pass the Luhn check."""

    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            x = d.substr(F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + digit(i))

    return let(digits(m), total) % 10 == 0


def mod97(m: Column) -> Column:
    """True where the ISO 7064 remainder of an IBAN is 1."""

    def rest(s: Column) -> Column:
        turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))

        def step(a: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

        return F.aggregate(F.split(turned, "", -1), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))

    return let(F.regexp_replace(m, " ", ""), rest) == 1


def ibans(text: Column) -> Column:
    """Spans of IBANs: at each start the end at a word boundary that has the country's length and passes mod 97.

    A country that is not listed may end at any word boundary; the longest that passes is taken.
    What follows an IBAN is never part of it, and each start is tried whatever the one before it reached.
    """
    lengths = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes.split() for x in (code, n)])
    starts = matches(text, IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}"), CONTEXT_CHARS, IBAN_WINDOW)

    def ends(all_: Column, reach: Column, wanted: Column) -> Column:
        def fits(n: Column) -> Column:
            value = all_.substr(F.lit(1), n)
            whole = (all_.substr(n, F.lit(1)) != " ") & ~all_.substr(n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            return whole & (wanted.isNull() | (F.length(F.replace(value, F.lit(" "), F.lit(""))) == wanted)) & mod97(value)

        return F.array_max(F.filter(F.sequence(F.lit(15), reach), fits))

    def grown(x: Column) -> Column:
        reach = F.length(x["m"]) + F.length(F.regexp_extract(x["right"], IBAN_RUN, 0))
        n = let(F.concat(x["m"], x["right"]), lambda a: ends(a, reach, F.try_element_at(lengths, F.left(x["m"], F.lit(2)))))
        return let(
            n,
            lambda n: F.struct(
                x["s"].alias("s"),
                (x["s"] + n).alias("e"),
                F.concat(x["m"], x["right"]).substr(F.lit(1), n).alias("m"),
                x["before"].alias("before"),
                x["left"].alias("left"),
                x["right"].substr(n - 3, F.lit(CONTEXT_CHARS)).alias("right"),
                x["near"].alias("near"),
            ),
        )

    return F.filter(F.transform(starts, grown), lambda x: x["e"].isNotNull())


def scored(spans: Column, kind: str) -> Column:
    """Add kind and score.

    Words that raise a score are looked for on both sides of the span, across its neighbours; words
    that lower it in the text before the span, back to the span before it, and in the span.
    """

    def one(x: Column) -> Column:
        around = F.concat_ws("\n", F.right(x["left"], F.lit(CONTEXT_CHARS)), F.left(x["right"], F.lit(CONTEXT_CHARS)), x["near"])
        near = F.when(around.rlike(CONTEXT[kind]), F.lit(0.2)).otherwise(F.lit(0.0))
        decoy = F.when(x["before"].rlike(DECOY) | x["m"].rlike(DECOY), F.lit(0.3)).otherwise(F.lit(0.0))
        score = F.least(F.lit(1.0), F.round(F.lit(PRIOR[kind]) + near - decoy, 3))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["m"].alias("value"), score.alias("score"))

    return F.transform(spans, one)


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind; the first four are the base, iban and ssn are added."""
    n_digits = lambda m: F.length(digits(m))
    find = lambda pattern, present: matches(text, pattern, present, CONTEXT_CHARS, CONTEXT_CHARS)
    out = {
        "email": find(EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find(IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: x["m"].rlike(IP_PARTS)),
        "card": F.filter(find(CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: luhn(x["m"])),
        "phone": F.filter(find(PHONE, F.contains(text, F.lit("+"))), lambda x: n_digits(x["m"]).between(9, 15)),
        "iban": ibans(text),
        "ssn": find(SSN, text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    }
    return {k: scored(v, k) for k, v in out.items()}


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", added_score: float = ADDED_SCORE) -> DataFrame:
    """``id_col`` and ``findings`` array<struct<kind,start,end,value,score>> of every row.

    Findings are ordered by kind as in KINDS, then start. Base kinds are kept at any score;
    an added kind (iban, ssn) is kept from ``added_score`` on, so an ssn needs its context.
    Rows with the same text get the same findings.
    """
    found = proposals(flat(F.col("text_")))
    parts = [found[k] if k in KINDS[:4] else F.filter(found[k], lambda x: x["score"] >= added_score) for k in KINDS]
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    return rows.select(F.col("id_").alias(id_col), F.concat(*parts).alias("findings"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, base digest and span string of ``scan_pii``'s findings."""
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(text(of(*KINDS[:4])), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda x: x["score"] >= 0.7)).cast("long").alias("n_confident"),
    )


__all__ = ["scan_pii", "digest", "luhn", "mod97"]
