"""Personal data and secrets in texts: proposed by patterns, confirmed by checks, weighed by nearby words.

A kind of span has a pattern that proposes, a check that confirms (Luhn for cards, the remainder
modulo 97 for bank accounts, ranges for addresses and numbers) and a prior score. Words right before
and after a span raise or lower its score. Spans of the four basic kinds are kept whatever their
score; the others are kept from ``LEAST_SCORE`` on.

Only DataFrame functions, and no shuffle: a text's matches and the gaps between them give its spans'
places, as running sums of their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LEAST_SCORE = 0.5
BEFORE, AFTER = 40, 20
"""Code points of context before and after a span, up to the neighbouring proposals of its kind."""

RAISED, LOWERED = 0.3, 0.3
BLOCK = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_DIGIT = "[^0-9]"
IP_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SECRET_VALUE = "[A-Za-z0-9+/_.-]{16,}$"


@dataclass(frozen=True)
class Kind:
    """``proposed`` is for Java, ``plain`` the same pattern without its possessive quantifiers and look-arounds."""

    name: str
    order: int
    proposed: str
    plain: str
    base: bool
    prior: float
    raising: tuple[str, ...] = ()
    lowering: tuple[str, ...] = ()
    hint: str | None = None  # a text without this string holds no match
    tail: str | None = None  # the span is only this end of the match

    @property
    def check(self) -> str:
        return f"{self.name}{'' if self.base else '_added'}"


_CARD_WORDS = ("card", "cards", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta")
_PHONE_WORDS = ("phone", "tel", "telephone", "mobile", "cell", "fax", "call", "telefon", "handy", "telefono", "movil", "portable", "appelez")
_NUMBER_WORDS = ("order", "invoice", "isbn", "serial", "version", "release", "build", "chapter", "section", "part")

# Possessive quantifiers match iteratively and never retry: a run of a million digits neither overflows
# the stack nor takes quadratic time. What follows a run can't start with the run's characters, so the
# matches are the same.
KINDS = (
    Kind(
        "email",
        0,
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        True,
        0.9,
        ("mail", "email", "contact", "kontakt", "correo", "courriel"),
        hint="@",
    ),
    Kind(
        "ip",
        1,
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]+(?:\.[0-9]+){3}",
        True,
        0.6,
        ("ip", "host", "server", "address", "adresse", "servidor", "serveur"),
        _NUMBER_WORDS,
        hint=".",
    ),
    Kind(
        "card",
        2,
        # Whole chains of digits only: a chain starts where no digit, or digit and separator, stands before.
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        r"[0-9](?:[\x20-]?[0-9])+",
        True,
        0.7,
        _CARD_WORDS,
        _NUMBER_WORDS,
    ),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, _PHONE_WORDS, hint="+"),
    # Added: a card next to other numbers, whose chain of digits is no card.
    Kind("card", 2, r"[0-9]{12,}+", r"[0-9]{12,}", False, 0.6, _CARD_WORDS, _NUMBER_WORDS),
    Kind(
        "phone",
        3,
        r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
        r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
        False,
        0.3,
        _PHONE_WORDS,
        _NUMBER_WORDS,
    ),
    Kind(
        "iban",
        4,
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        False,
        0.9,
        ("iban", "account", "bank", "konto", "compte", "cuenta"),
        (),
    ),
    Kind(
        "ssn",
        5,
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        False,
        0.3,
        ("ssn", "social", "security", "taxpayer"),
        _NUMBER_WORDS,
    ),
    Kind(
        "secret",
        6,
        r"(?:[Pp]assword|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa]ccess[_-]?[Kk]ey)"
        r"[\x22']?\x20{0,3}[:=]\x20{0,3}[\x22']?[A-Za-z0-9+/_.-]{16,}+",
        r"(?:[Pp]assword|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa]ccess[_-]?[Kk]ey)"
        r"[\x22']?\x20{0,3}[:=]\x20{0,3}[\x22']?[A-Za-z0-9+/_.-]{16,}",
        False,
        0.7,
        (),
        ("example", "sample", "dummy", "placeholder"),
        tail=SECRET_VALUE,
    ),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, NO_DIGIT, "")


def _mod97(x: Column) -> Column:
    """The remainder of a bank account number: country and check digits go last, letters count from 10."""
    moved = F.concat(F.substring(x, 5, 99), F.substring(x, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _confirmed(kind: Kind, m: Column, before: Column, after: Column) -> Column:
    digits = _digits(m)
    apart = ~before.rlike("[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]")
    if kind.check == "email":
        return F.lit(True)
    if kind.check == "ip":
        return m.rlike(rf"^({IP_PART}\.){{3}}{IP_PART}$")
    if kind.check in ("card", "card_added"):
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind.check == "phone":
        return F.length(digits).between(9, 15)
    if kind.check == "phone_added":
        return F.length(digits).between(8, 12) & ~before.rlike(r"[0-9+()][\x20().-]?$") & ~after.rlike("^[0-9]")
    if kind.check == "iban_added":
        return apart & (_mod97(F.regexp_replace(m, " ", "")) == 1)
    if kind.check == "ssn_added":
        return apart & ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$")
    return m.rlike(f"[0-9][A-Za-z+/_.-]*{SECRET_VALUE}|[0-9][^:=]*$") & m.rlike("[:=][^:=]*[A-Za-z][^:=]*$")


def _holds(context: Column, words: tuple[str, ...]) -> Column:
    if not words:
        return F.lit(False)
    return F.translate(context, UPPER, LOWER).rlike(f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)")


def _running(steps: Column) -> Column:
    """Inclusive running sums of an array, block by block, so that no array grows element by element to the full length."""
    scan = lambda xs, first: F.aggregate(
        xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )
    n = F.size(steps)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    )
    totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x))
    firsts = F.slice(scan(totals, F.lit(0)), F.lit(1), F.size(totals))
    return F.flatten(F.zip_with(blocks, firsts, lambda xs, first: F.slice(scan(xs, first), F.lit(2), F.size(xs))))


SPAN = "array<struct<start:int,kind_order:int,end:int,kind:string,score:double,base:boolean>>"


def _proposals(kind: Kind, text: Column) -> Column:
    """Matches, and of every gap around them its length and the text next to the matches; null where there is none."""
    pattern = F.lit(kind.proposed)
    some = text.rlike(kind.proposed)
    if kind.hint is not None:
        some = text.contains(kind.hint) & some
    gap = lambda g: F.struct(
        F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("before"), F.left(g, F.lit(AFTER)).alias("after")
    )
    return F.when(
        some,
        F.struct(
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
            F.transform(F.split(text, kind.proposed, -1), gap).alias("gaps"),
        ),
    )


def _ends(found: Column) -> Column:
    """Where each match ends, in code points."""
    return F.when(
        found.isNotNull(),
        _running(F.transform(found["m"], lambda m, i: F.length(m) + F.get(found["gaps"], i)["n"])),
    )


def _spans(kind: Kind, found: Column, ends: Column) -> Column:
    def weigh(m: Column, i: Column) -> Column:
        before, after = F.get(found["gaps"], i)["before"], F.get(found["gaps"], i + 1)["after"]
        own = m if kind.tail is None else F.regexp_extract(m, kind.tail, 0)
        near = lambda words: _holds(before, words) | _holds(after, words)
        score = F.round(
            F.lit(kind.prior)
            + F.when(near(kind.raising), RAISED).otherwise(0.0)
            - F.when(near(kind.lowering), LOWERED).otherwise(0.0),
            3,
        )
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        end = F.get(ends, i)
        span = F.struct(
            (end - F.length(own)).alias("start"),
            F.lit(kind.order).alias("kind_order"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            score.alias("score"),
            F.lit(kind.base).alias("base"),
        )
        kept = _confirmed(kind, m, before, after)
        return F.when(kept if kind.base else kept & (score >= LEAST_SCORE), span)

    spans = F.filter(F.transform(found["m"], weigh), lambda s: s.isNotNull())
    return F.coalesce(spans, F.array()).cast(SPAN)


def find_spans(documents: DataFrame, column: str = "text", into: str = "spans") -> DataFrame:
    """Adds an array of spans, by start, kind and end: ``start, kind_order, end, kind, score, base``.

    Places count code points, ends are exclusive. A null or empty text has no spans; repeated rows get the
    same spans each; texts of any length are searched whole. An added span equal to a basic one of its
    kind is left out. Other columns stay as they are, whatever their names; one named ``into`` is replaced.
    An empty table gives an empty table.
    """
    own = [f"_pii{i}" for i in range(len(KINDS))]
    text = documents[column]
    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), text.alias("_text"))
    found = whole.select("_row", *[_proposals(k, F.col("_text")).alias(c) for k, c in zip(KINDS, own, strict=True)])
    placed = found.select("_row", *own, *[_ends(F.col(c)).alias(f"{c}e") for c in own])
    parts = placed.select(
        "_row", *[_spans(k, F.col(c), F.col(f"{c}e")).alias(c) for k, c in zip(KINDS, own, strict=True)]
    )
    base = F.concat(*[F.col(c) for k, c in zip(KINDS, own, strict=True) if k.base])
    added = F.concat(*[F.col(c) for k, c in zip(KINDS, own, strict=True) if not k.base])
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind_order"], s["end"]))
    every = parts.select("_row", base.alias("_base"), added.alias("_added"), place(base).alias("_places"))
    new = F.filter(
        F.col("_added"),
        lambda s: ~F.array_contains(F.col("_places"), F.struct(s["start"], s["kind_order"], s["end"])),
    )
    ordered = F.when(
        F.size("_base") + F.size("_added") > 0, F.array_sort(F.concat(F.col("_base"), new))
    ).otherwise(F.array().cast(SPAN))
    others = [F.col("_row")[c].alias(c) for c in documents.columns if c != into]
    return every.select(*others, ordered.alias(into))


def digest(found: DataFrame) -> DataFrame:
    """Per document, from the rows of :func:`find_spans`: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The numbers and the hash are of the basic spans, ``spans`` are all of them.
    """
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("_base"))
    count = lambda name: F.size(F.filter("_base", lambda s: s["kind"] == name)).cast("long")
    return base.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SQL_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""length({_SQL_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(reverse({_SQL_DIGITS}), i, 1)::INT
       WHEN substr(reverse({_SQL_DIGITS}), i, 1)::INT > 4 THEN 2 * substr(reverse({_SQL_DIGITS}), i, 1)::INT - 9
       ELSE 2 * substr(reverse({_SQL_DIGITS}), i, 1)::INT END)) % 10 = 0"""
_SQL_APART = "NOT regexp_matches(before, '[A-Za-z0-9_]$') AND NOT regexp_matches(after, '^[A-Za-z0-9_]')"
_SQL_ALNUM = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_SQL_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_SQL_ALNUM}, ''), lambda c:
  CASE WHEN regexp_matches(c, '[0-9]') THEN c::BIGINT ELSE ascii(c)::BIGINT - 55 END)),
  lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"""
_SQL_CHECKS = {
    "email": "true",
    "ip": f"regexp_matches(m, '^({IP_PART}\\.){{3}}{IP_PART}$')",
    "card": _SQL_LUHN,
    "card_added": _SQL_LUHN,
    "phone": f"length({_SQL_DIGITS}) BETWEEN 9 AND 15",
    "phone_added": f"length({_SQL_DIGITS}) BETWEEN 8 AND 12 AND NOT regexp_matches(before, '[0-9+()][\\x20().-]?$')"
    " AND NOT regexp_matches(after, '^[0-9]')",
    "iban_added": f"{_SQL_APART} AND {_SQL_MOD97}",
    "ssn_added": f"{_SQL_APART} AND NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-')"
    " AND NOT regexp_matches(m, '0000$')",
    "secret_added": f"regexp_matches(m, {_text('[0-9][A-Za-z+/_.-]*' + SECRET_VALUE + '|[0-9][^:=]*$')})"
    " AND regexp_matches(m, '[:=][^:=]*[A-Za-z][^:=]*$')",
}


def _sql_near(words: tuple[str, ...]) -> str:
    if not words:
        return "false"
    pattern = _text(f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"(regexp_matches({lower('before')}, {pattern}) OR regexp_matches({lower('after')}, {pattern}))"


def _sql_kind(kind: Kind) -> str:
    own = "length(m)" if kind.tail is None else f"length(regexp_extract(m, {_text(kind.tail)}))"
    score = (
        f"round({kind.prior} + CASE WHEN {_sql_near(kind.raising)} THEN {RAISED} ELSE 0 END"
        f" - CASE WHEN {_sql_near(kind.lowering)} THEN {LOWERED} ELSE 0 END, 3)"
    )
    least = "" if kind.base else f" AND {score} >= {LEAST_SCORE}"
    return f"""
SELECT r, upto - {own} AS s, {kind.order} AS k, upto AS e, '{kind.name}' AS kind, {str(kind.base).lower()} AS base
FROM (SELECT r, m[i] AS m, right(g[i], {BEFORE}) AS before, left(g[i + 1], {AFTER}) AS after,
             (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT AS upto
      FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT r, regexp_extract_all(text, {_text(kind.plain)}) AS m,
                         regexp_split_to_array(text, {_text(kind.plain)}) AS g FROM d)))
WHERE {_SQL_CHECKS[kind.check]}{least}"""


PII_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join(_sql_kind(k) for k in KINDS)}),
q AS (SELECT r, s, k, e, kind, bool_or(base) AS base FROM p GROUP BY r, s, k, e, kind),
t AS (SELECT r,
  count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip,
  count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (base) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM q GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""
