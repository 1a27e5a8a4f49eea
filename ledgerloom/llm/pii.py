"""Personal data and secrets, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (part ranges, digit counts, Luhn, mod 97, mod 11, check
letters), and words near a proposal move its score: those that name its kind, in the languages of the corpus, raise it on
either side, words that name something else lower it before the span. A proposal counts when its score reaches LEAST; the
base kinds of the contract always count and carry their score along. A regular expression gives no positions, so texts
are cut by it: the pieces between the matches and the matches themselves, measured in code points and summed up in two
levels, give the starts. Patterns only start where a match can start, and quantifiers are possessive, so a text costs
linear time and no stack whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table, whole

#: Fixed values of the query's contract, written so that a match is only tried at the start of a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_OK = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}"
#: The lengths of account numbers (ISO 13616, and the countries that use the form without being in its registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN_LENGTHS.values()).split())


def _account(length: int) -> str:
    """The country's letters, and after them just as many characters as its numbers have, with or without spaces at each fourth."""
    groups, rest = divmod(length - 4, 4)
    return f"(?:{IBAN_LENGTHS[length].replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{groups}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else "")


#: Of letters that are no such country, 15 to 34 characters, up to where a known country's number may begin.
_OTHER = rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_KNOWN})[0-9]{{2}})\x20?[A-Z0-9]{{4}}){{2,7}}+(?:(?!\x20(?:{_KNOWN})[0-9]{{2}})\x20?[A-Z0-9]{{1,3}})?+"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(map(_account, IBAN_LENGTHS))}|{_OTHER})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Spanish, French and German personal numbers.
DNI = r"(?<![A-Za-z0-9])[0-9]{8}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])"
NIR = r"(?<![A-Za-z0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![\x20]?[A-Za-z0-9])"
STEUER = r"(?<![A-Za-z0-9])[1-9][0-9](?:\x20?[0-9]{3}){3}(?![\x20]?[0-9])"
#: Secrets: keys that name their issuer, heads of private keys, values behind a name that says so, bare long hex.
NAMED_KEY = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
ASSIGNED = r"(?i)(?<![A-Za-z0-9])(?:[a-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|passwort|kennwort|contraseña|clave|mot_?de_?passe|jeton)[\"']?\x20?(?:=|:|=>)\x20?(?:\"[^\s\"]{8,200}\"|'[^\s']{8,200}'|(?=[A-Za-z+/_.=-]{0,200}[0-9])[A-Za-z0-9+/_.=-]{12,200}+)"
HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"

#: Words in favour of a kind, in English, German, French and Spanish, and words that name something else.
WORDS = {
    "email": "e-?mail|mail|contact|kontakt|contacto|courriel|correo|adresse|schreib",
    "ip": "ip|server|host|client|adresse|dirección|serveur|servidor",
    "card": "card|visa|mastercard|amex|kreditkarte|karte|carte|tarjeta|credit|crédit|crédito",
    "phone": "phone|call|tel|mobile|telefon|anruf|handy|téléphone|appel|portable|teléfono|llama|móvil",
    "iban": "iban|account|bank|konto|compte|banque|cuenta|banco",
    "ssn": "ssn|social security|taxpayer|sozialversicherung|sécurité sociale|seguridad social",
    "dni": "dni|nif|nie|documento|identidad|identity",
    "nir": "nir|insee|sécurité sociale|sécu|social security|assuré",
    "steuer": "steuer|steuer-?id|idnr|steuernummer|identifikationsnummer|tax",
    "key": "key|secret|token|schlüssel|clé|clave",
    "secret": "secret|token|password|credential|auth|passwort|geheim|mot de passe|contraseña|clave",
    "hex": "api|key|secret|token|password|credential|auth|schlüssel|passwort|clé|jeton|clave|contraseña",
}
AGAINST = r"order|invoice|part|serial|isbn|commit|sha|md5|checksum|hash|example|version|bestellung|rechnung|teilenummer|beispiel|commande|facture|exemple|pedido|factura|ejemplo"
#: Code points beside a proposal in which words count, what words for and against add and take, and the least score.
CONTEXT, FOR, MINUS, LEAST = 40, 0.5, 0.4, 0.6
BASE = ("email", "ip", "card", "phone")
CHUNK = 256


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match: gaps (one more than matches) and matches, in code points; chunks first, then within them."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    chunks = F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, F.lit(CHUNK)))
    width = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["g"] + s["m"]))
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("all"))
    one_more = lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
    offsets = F.aggregate(width, zero(F.lit(0)), one_more, lambda a: a["all"])
    step = lambda a, s: F.struct((a["at"] + s["g"] + s["m"]).alias("at"), F.concat(a["all"], F.array(a["at"] + s["g"])).alias("all"))
    return F.flatten(F.zip_with(chunks, offsets, lambda c, o: F.aggregate(c, zero(o), step, lambda a: a["all"])))


def _values(digits: Column) -> Column:
    """The code points of a short string, one by one."""
    return F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.ascii(F.substring(digits, i, F.lit(1))))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(account: Column) -> Column:
    body = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(body, F.lit(5), F.length(body)), F.substring(body, 1, 4))
    rest = F.aggregate(_values(turned), F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)
    return F.length(body).between(15, 34) & (rest == 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _check_letter(m: Column) -> Column:
    """The letter of a Spanish number is that of its remainder by 23."""
    place = (F.substring(m, 1, 8).cast("long") % 23 + 1).cast("int")
    return F.right(m, F.lit(1)) == F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), place, F.lit(1))


def _nir(m: Column) -> Column:
    """The last two digits of a French number complete the rest to a multiple of 97."""
    d = _digits(m)
    return (F.substring(d, 1, 13).cast("long") + F.substring(d, 14, 2).cast("long")) % 97 == 0


def _mod11(m: Column) -> Column:
    """ISO 7064, mod 11, 10, of eleven digits; the first ten hold one digit two or three times, as German numbers do."""
    d = _digits(m)
    ten = F.transform(_values(F.substring(d, 1, 10)), lambda c: c - 48)

    def step(a: Column, v: Column) -> Column:
        s = (a + v) % 10
        return 2 * F.when(s == 0, 10).otherwise(s) % 11

    check = (11 - F.aggregate(ten, F.lit(10), step)) % 10
    return (F.size(F.array_distinct(ten)).between(8, 9)) & (check == F.right(d, F.lit(1)).cast("int"))


def score(kind: str, start: float, text: Column, at: Column, end: Column) -> Column:
    """The kind's own score, moved by words within CONTEXT code points of the span; 0 to 1."""
    before = F.substring(text, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)))
    behind = F.substring(text, end + 1, F.lit(CONTEXT))
    named = rf"(?iu)(?<!\p{{L}})(?:{WORDS[kind]})"
    other = rf"(?iu)(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})"
    moved = start + F.when(before.rlike(named) | behind.rlike(named), FOR).otherwise(0.0) - F.when(before.rlike(other), MINUS).otherwise(0.0)
    return F.round(F.greatest(F.least(moved, F.lit(1.0)), F.lit(0.0)), 2)


@dataclass(frozen=True)
class Kind:
    """What a text must hold to be searched at all, the pattern, the validator, and the score before words count."""

    name: str
    pattern: str
    may: Callable[[Column], Column]
    start: float
    check: Callable[[Column], Column] | None = None


#: In the order that spans of one start take.
KINDS = (
    Kind("email", EMAIL, lambda t: F.contains(t, F.lit("@")), 0.9),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), 0.5, lambda m: m.rlike(IP_OK)),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), 0.7, lambda m: _luhn(_digits(m))),
    Kind("phone", PHONE, lambda t: F.contains(t, F.lit("+")), 0.6, lambda m: F.length(_digits(m)).between(10, 15)),
    Kind("iban", IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), 1.0, _mod97),
    Kind("ssn", SSN, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), 0.3),
    Kind("dni", DNI, lambda t: t.rlike(r"[0-9]{8}-?[A-Z]"), 0.3, _check_letter),
    Kind("nir", NIR, lambda t: t.rlike(r"[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}"), 0.4, _nir),
    Kind("steuer", STEUER, lambda t: t.rlike(r"[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}"), 0.3, _mod11),
    Kind("key", NAMED_KEY, lambda t: t.rlike("AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN"), 1.0),
    Kind("secret", ASSIGNED, lambda t: t.rlike("(?i)token|secret|passw|pwd|key|kennwort|contraseña|clave|passe|jeton"), 0.7),
    Kind("hex", HEX, lambda t: t.rlike("[0-9a-f]{32}"), 0.3),
)


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `pii`: array<struct<start, rank, end, kind, score>>, ordered by start, then kind in the order of KINDS.

    Starts and ends (exclusive) count code points of the whole text; a null text counts as empty and has no spans.
    Spans of one kind never overlap; spans of different kinds may. Repeated rows stay, a column of df named pii is
    replaced, and all others pass through; an empty df gives no rows.
    """
    plain = df.drop("pii")
    text, *names = spare(plain, "text_of", *(f"found_{k.name}" for k in KINDS))
    out, t = plain.withColumn(text, whole(text_col)), F.col(text)
    for k, name in zip(KINDS, names, strict=True):
        # No match (most texts) ends here: an empty array, and no cutting below.
        out = out.withColumn(name, F.when(k.may(t), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))))
    spans = []
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    for rank, (k, name) in enumerate(zip(KINDS, names, strict=True)):
        found = F.col(name)
        named = F.zip_with(found, _starts(F.split(text, k.pattern, -1), found), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        made = F.transform(F.filter(named, _confirmed(k)) if k.check else named, _span(k, rank, t))
        made = made if k.name in BASE else F.filter(made, lambda s: s["score"] >= LEAST)
        spans.append(F.when(F.size(found) > 0, made).otherwise(empty))
    return out.withColumn("pii", F.array_sort(F.concat(*spans))).drop(text, *names)


def _confirmed(k: Kind) -> Callable[[Column], Column]:
    return lambda x: k.check(x["m"])


def _span(k: Kind, rank: int, text: Column) -> Callable[[Column], Column]:
    def made(x: Column) -> Column:
        end = x["s"] + F.length(x["m"])
        told = score(k.name, k.start, text, x["s"], end)
        return F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(k.name).alias("kind"), told.alias("score"))

    return made


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    counts = [F.size(F.filter("pii", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]  # noqa: B023
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return out.select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"), scores.alias("scores"), F.size("pii").cast("long").alias("n_spans")
    )


SQL: dict[str, str] = {}
QUERIES = {"op7_pii": op7_pii}
