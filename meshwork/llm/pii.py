"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a small deterministic parser expands to the span's borders
and validates it. Every parser reads a character a bounded number of times, so a text of any
length takes linear time.

Base kinds, leftmost and non-overlapping within a kind: email, ip (four parts of at most
255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits). Further kinds, found by
cues at the border of a word, and left out where they lie in a base span: url, iban (mod 97),
account (digits or groups after an account cue), secret (the value assigned to a credential's
name, with blanks and quotes or without; a key of a known form; a private key block) and address
(house number and street of four languages, with postcode and town if they follow).

Null and empty texts have no spans. Rows are independent: repeated rows give repeated
results, an empty table gives an empty one, columns other than the two named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, map_slices, strings

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account", "secret", "address")
KINDS = BASE_KINDS + MORE_KINDS

# Cue words, in lower case but for the key beginnings.
SCHEMES = ("http://", "https://", "ftp://")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account number", "account no", "acct no", "kontonummer", "numéro de compte", "número de cuenta", "ssn", "social security number", "passport no", "passport number")
SECRET_CUES = ("password", "passwd", "pwd", "passwort", "secret", "token", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key", "auth_key", "bearer")
KEY_BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "AIza", "eyJ", "sk_live_", "sk-")
KEY_BLOCK = "-----BEGIN "
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive", "st.", "ave.", "rd.", "straße", "strasse", "str.", "rue", "calle", "avenida", "plaza", "paseo", "chemin")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"']+")
IBAN_BODY = re.compile(r"[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT_BODY = re.compile(r"[ :#.]{0,4}([0-9](?:[ -]?[0-9]){5,33})(?![0-9])")
#: After a credential's name: perhaps a closing quote, a sign of assignment, perhaps an opening quote, the value.
SECRET_BODY = re.compile(r"""["']?[ \t]{0,3}(?:[:=]|=>|:=)[ \t]{0,3}(?:(["'])([^\s"']{6,})\1|([^\s,;"'<>]{8,}))""")
BEARER_BODY = re.compile(r"[ \t]{1,3}([A-Za-z0-9._~+/-]{16,}=*)")
KEY_BODY = re.compile(r"[A-Za-z0-9_.-]{16,}")
BLOCK_REST = re.compile(r"[A-Z ]{0,40}PRIVATE KEY-----")
TOWN = r"(?:,? [0-9]{5} [A-ZÄÖÜÉÈÀÑ][\w'-]{1,30}(?: [A-ZÄÖÜÉÈÀÑ][\w'-]{1,30})?)?"
NAMES = r"[A-ZÄÖÜÉÈÀÑ][\w'.-]{0,30}(?: [A-ZÄÖÜÉÈÀÑ][\w'.-]{0,30}){0,3}"
OF = r"(?:(?:de la|de l'|del|des|de|du|d'|la|le|los|las) ?){0,2}"
#: House number and names before a street's word, and what may follow; then forms with the street's word in front.
BEFORE_STREET = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'.-]{0,30} ){1,4}\Z")
AFTER_STREET = re.compile(r"(?:,? (?:Apt|Suite|Unit|Floor)\.? ?[0-9A-Za-z]{1,6})?(?:,? [A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?,? [A-Z]{2} [0-9]{5}(?:-[0-9]{4})?)?")
GERMAN_NAME = re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß-]{0,40}\Z")
GERMAN_WORD = re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß.-]{1,40} \Z")
GERMAN_REST = re.compile(r" [0-9]{1,4}[a-z]?(?!\w)" + TOWN)
NUMBER_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,4}(?: (?:bis|ter))?,? \Z")
FRENCH_REST = re.compile(" " + OF + NAMES + TOWN)
SPANISH_REST = re.compile(" " + OF + NAMES + r",? (?:n\.?º ?)?[0-9]{1,4}(?!\w)" + TOWN)
#: Characters before a street's word that are looked at.
REACH = 140
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")


def anchors():
    """The automaton of all anchors; each has its kind and its length as value."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("key", KEY_BEGINNINGS), ("block", (KEY_BLOCK,)), ("street", STREET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()} if kind not in ("key", "block") else {word}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def secret_value(text: str, at: int, after: int) -> tuple[int, int] | None:
    """What is assigned to a credential's name; outside quotes it has a digit or a sign, or is no word of a language."""
    if text[at:after].lower() == "bearer":
        m = BEARER_BODY.match(text, after)
        return m.span(1) if m and any(c in DIGITS for c in m[1]) else None
    m = SECRET_BODY.match(text, after)
    if not m:
        return None
    if m[1]:
        return m.span(2)
    value = m[3].rstrip(".:!?)")
    return (m.start(3), m.start(3) + len(value)) if len(value) >= 8 and not value.isalpha() else None


def key_value(text: str, at: int, after: int) -> tuple[int, int] | None:
    m = KEY_BODY.match(text, after)
    if not m:
        return None
    begin, n = text[at:after], len(m[0])
    ok = {"AKIA": n == 16, "ASIA": n == 16, "eyJ": m[0].count(".") == 2}.get(begin, n >= 20) and any(c in DIGITS for c in m[0])
    return (at, m.end()) if ok else None


def address(text: str, at: int, after: int) -> tuple[int, int] | None:
    word, low = text[at:after].lower(), max(0, at - REACH)
    if word in ("straße", "strasse", "str."):
        tied = at and (text[at - 1].isalnum() or text[at - 1] == "-")
        begin = GERMAN_NAME.search(text, low, at) if tied else GERMAN_WORD.search(text, low, at) if text[at].isupper() else None
        m = GERMAN_REST.match(text, after) if begin else None
        return (begin.start(), m.end()) if m else None
    if at and text[at - 1].isalnum():
        return None
    if word in ("calle", "avenida", "plaza", "paseo"):
        m = SPANISH_REST.match(text, after)
        return (at, m.end()) if m else None
    if word in ("rue", "avenue", "boulevard", "chemin") and (begin := NUMBER_BEFORE.search(text, low, at)) and (m := FRENCH_REST.match(text, after)):
        return begin.start(), m.end()
    if text[at].isupper() and (after == len(text) or not text[after].isalnum()) and (begin := BEFORE_STREET.search(text, low, at)):
        return begin.start(), AFTER_STREET.match(text, after).end()
    return None


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def find(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, by start; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = quad_end = chain_end = phone_end = 0
    cues = []
    for last, (kind, n) in automaton.iter(text):
        at = last - n + 1
        if kind == "digit":
            if at and text[at - 1] in DIGITS:
                continue
            if at >= quad_end and (m := QUAD.match(text, at)):
                quad_end = m.end()
                # A part of over three digits may still be at most 255 after its zeros.
                if all(len(p) <= 3 and int(p) <= 255 or len(p) > 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.groups()):
                    out["ip"].append(m.span())
            if at >= chain_end and (m := DIGIT_CHAIN.match(text, at)):
                chain_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            begin = at
            while begin > email_end and text[begin - 1] in LOCAL_PART:
                begin -= 1
            if begin < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((begin, email_end))
        elif kind == "plus":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        else:
            cues.append((kind, at, last + 1))
    if cues:
        taken = merged([s for k in BASE_KINDS for s in out[k]])
        inside = lambda begin, end: (i := bisect_right(taken, (begin, len(text)))) and taken[i - 1][1] >= end
        ends, no_end = dict.fromkeys(MORE_KINDS, 0), False
        for kind, at, after in cues:
            to, span = kind, None
            border = not at or not text[at - 1].isalnum()
            if kind == "street":
                to, span = "address", address(text, at, after)
            elif not border:
                continue
            elif kind == "url" and (m := URL_REST.match(text, after)):
                span = (at, after + len(m[0].rstrip(".,;:!?)")))
            elif kind == "iban" and (m := IBAN_BODY.match(text, after)) and iban_valid(m[1]):
                span = m.span(1)
            elif kind == "account" and (m := ACCOUNT_BODY.match(text, after)):
                span = m.span(1)
            elif kind == "secret":
                span = secret_value(text, at, after)
            elif kind == "key":
                to, span = "secret", key_value(text, at, after)
            elif kind == "block" and not no_end and (m := BLOCK_REST.match(text, after)):
                to, end = "secret", text.find("-----END " + m[0], m.end())
                no_end = end < 0
                span = None if no_end else (at, end + len("-----END " + m[0]))
            if span and span[0] >= ends[to] and span[1] > span[0] and not inside(*span):
                ends[to] = span[1]
                out[to].append(span)
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, and spans array<struct<kind, start, end>> in the order of KINDS, then start."""

    def make():
        automaton = anchors()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": k, "start": b, "end": e} for k, spans in find(t, automaton).items() for b, e in spans] if t else [] for t in strings(part.column(1))]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], [id_col, "spans"])

        return handle

    return map_slices(keyed(df, id_col, text_col), make, f"`{id_col}` {id_type(df, id_col)}, spans array<struct<kind:string,start:int,end:int>>")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with each span of these kinds replaced by [KIND] in its text; overlapping spans become one, named by the first."""

    def make():
        automaton = anchors()

        def cut(text: str) -> str:
            spans = sorted((b, e, k) for k, s in find(text, automaton).items() if k in kinds for b, e in s)
            out, done = [], 0
            for b, e, k in spans:
                if b >= done:
                    out += [text[done:b], f"[{k.upper()}]"]
                done = max(done, e)
            return "".join(out) + text[done:]

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [cut(t) if there else None for t, there in zip(strings(part.column(at)), part.column(at).is_valid().to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

        return handle

    at = df.columns.index(text_col)
    return map_slices(df, make, df.schema, text_at=at)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        id_col,
        *(F.size(of((k,))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text(of(BASE_KINDS)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
