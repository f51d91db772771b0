"""PII: detected entities get keyed, type-consistent surrogates.

E-mail addresses, phone numbers, payment cards (13 to 19 digits with a valid check digit, or 15 or 16
in groups), bank accounts (IBAN), identity numbers written ddd-dd-dddd, IPv4 and IPv6 addresses, secrets (values of token, key,
password and the like; long hexadecimal strings) and names after a title are found by patterns.

Surrogates of all but names come from a keyed permutation without fixed points of the strings of
one format: a Feistel network E over the format's numbers, then D(E(x) + 1). So two entities never
share a surrogate, none keeps its own, and one entity has one surrogate in all documents, without a
table of them: distinctness and coreference hold by construction and need no exchange. Entities are
permuted in a canonical form (digits of a phone number, small letters of an address) and the
mention's punctuation and case are put back. Cards and bank accounts keep their check digits' validity, addresses
their ranges, phone numbers their country code.

Names go the same way: the letters of a part are permuted among the words with vowels and consonants in
the same places, so that a surrogate has the script, length, capitals and shape of its name, different
names stay different in the whole corpus and a name has one surrogate whatever its document; a given
name gets an ending of the title's gender. Particles, hyphens and apostrophes stay. What stands alone
elsewhere in a document is a mention of a name found there if it is one of its parts, of three letters or
more, as a whole word with a capital; it gets the same surrogate.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"surrogates-1"
ROUNDS = 8

# fixed values: titles by gender, particles of names, and the endings of given names
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин", "г-н", "κύριος", "Κος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "госпожа", "г-жа", "κυρία", "Κα"),
    "n": ("Dr", "Prof"),
}
PARTICLES = "af al av bin da de del della den der des di dos du el ibn la las le los ten ter van von y zu zum zur".split()
CAPITAL_PARTICLES = "De Del Della Den Der Di Du La Le Ter Van Von".split()
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "l"},
    "cyrillic": {"m": "н", "f": "на", "n": "й"},
    "greek": {"m": "ς", "f": "νη", "n": "ν"},
}

_titles = "|".join(re.escape(t) for group in TITLES.values() for t in sorted(group, key=len, reverse=True))


def _alphabets() -> tuple[str, ...]:
    """Small letters of the scripts, vowels and consonants, plain and marked, apart; only letters whose
    capital is one letter and theirs alone."""
    scripts = (([*range(0x61, 0x7B), *range(0xDF, 0x180)], "aeiouæøœı"), (range(0x3AC, 0x3CF), "αεηιουω"), (range(0x430, 0x460), "аеиоуыэюяёіїє"))
    out = []
    for letters, vowels in scripts:
        groups: dict[tuple[bool, bool, int], str] = {}
        for ch in map(chr, letters):
            if ch.islower() and len(ch.upper()) == 1 and ch.upper().lower() == ch:
                kind = (unicodedata.normalize("NFD", ch)[0] in vowels, len(unicodedata.normalize("NFD", ch)) > 1 or ord(ch) >= 0xDF and ch < "Ͱ")
                groups[*kind, ord(ch) >> 8] = groups.get((*kind, ord(ch) >> 8), "") + ch
        out += groups.values()
    return tuple(out)


NAME_LETTERS = _alphabets()
_small = "".join(NAME_LETTERS) + "ßςŉ"
_big = "".join(NAME_LETTERS).upper()
_letter = f"[{_small}{_big}]"
#: A part of a name: a capital and more letters, with apostrophes and hyphens inside, but no possessive s.
_name_part = rf"[{_big}](?:{_letter}|['’](?!s\b){_letter}|-{_letter})+"
_between = rf" (?:(?:{'|'.join(PARTICLES)}) )*"
PART = re.compile(rf"(?<![\w'’-]){_name_part}(?!\w|-\w)")
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d))"
    r"|(?P<card>(?<![\d-])(?:\d{4}([ -]?)\d{4}\4\d{4}\4\d{4}|3[47]\d{2}([ -]?)\d{6}\5\d{5})(?![\d-]))"
    r"|(?P<iban>(?<![\w-])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: \d{1,3})?)(?![\w-]))"
    r"|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d))"
    r"|(?P<secret>(?:(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9+/_=.-]{8,}))"
    r"|(?P<hex>\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b)"
    # formats beyond the first ones; find() asks for the check digit and the number of digits
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d))"
    r"|(?P<pan>(?<![\w.+-])(?:\d{13,19}|3[0689]\d{2}[ -]\d{6}[ -]\d{4}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{3})(?![\w-]|\.\d))"
    r"|(?P<tel>(?<![\w.+-])(?:\+[1-9](?:[ ./-]?\(\d{1,5}\)|[ ./-]?\d){6,14}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|[2-9]\d{2}[2-9]\d{6})(?![\w-]|\.\d))"
    rf"|(?P<title>\b(?P<which>{_titles})\.?){_between}(?P<name>(?:[{_big}]\. ?)*{_name_part}(?:{_between}(?!(?:{_titles})\b){_name_part}){{0,2}})"
)
#: A text without any of these holds no entity.
HINT = re.compile(rf"[0-9@]|(?i:token|secret|passw|pwd|key)|\b(?:{_titles})\b")
RESULT = "doc_id long, text string, n_entities int, entities array<struct<type:string,start:int,end:int,surrogate:string>>"


# ---------------------------------------------------------------- keyed permutation
def _round(key: bytes, tag: bytes, k: int, half: int, modulus: int) -> int:
    data = tag + bytes([k]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    size = (modulus.bit_length() + 7) // 8 + 8
    return int.from_bytes(hashlib.shake_256(key + b"|" + data).digest(size), "big") % modulus


def permute(x: int, n: int, key: bytes, tag: bytes) -> int:
    """A keyed permutation of 0 .. n-1 without fixed points (n > 1)."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def forward(v: int) -> int:
        while True:
            left, right = divmod(v, b)
            for k in range(ROUNDS):
                if k % 2:
                    right = (right + _round(key, tag, k, left, b)) % b
                else:
                    left = (left + _round(key, tag, k, right, a)) % a
            v = left * b + right
            if v < n:
                return v

    def backward(v: int) -> int:
        while True:
            left, right = divmod(v, b)
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    right = (right - _round(key, tag, k, left, b)) % b
                else:
                    left = (left - _round(key, tag, k, right, a)) % a
            v = left * b + right
            if v < n:
                return v

    return backward((forward(x) + 1) % n)


LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = ("0123456789", LOWER, LOWER.upper())


#: Characters that are permuted as one number; longer strings go block by block.
PERMUTED = 64


def blocks(text: str, tag: bytes):
    """Pieces of PERMUTED characters and a tag for each, which holds the length of the whole and a
    digest of the pieces before: who knows the key reads them back one by one, so that blockwise
    permutations are one of the whole."""
    if len(text) <= PERMUTED:
        yield text, tag
        return
    before = hashlib.sha256(b"%d|" % len(text) + tag)
    for at in range(0, len(text), PERMUTED):
        part = text[at : at + PERMUTED]
        yield part, b"block" + before.digest()
        before.update(part.encode())


def permute_classes(text: str, key: bytes, tag: bytes) -> str:
    """Digits to digits, small letters to small, capitals to capitals; the rest stays and is part
    of the format."""
    return "".join(_permute_block(part, key, t) for part, t in blocks(text, tag))


def _permute_block(text: str, key: bytes, tag: bytes) -> str:
    where, value, n = [], 0, 1
    for at, ch in enumerate(text):
        alphabet = next((x for x in CLASSES if ch in x), None)
        if alphabet:
            where.append((at, alphabet))
            value = value * len(alphabet) + alphabet.index(ch)
            n *= len(alphabet)
    if n < 2:
        return text
    form = "".join("d" if c.isdigit() else "l" if c in LOWER else "u" if c in CLASSES[2] else c for c in text)
    value = permute(value, n, key, tag + form.encode())
    out = list(text)
    for at, alphabet in reversed(where):
        value, k = divmod(value, len(alphabet))
        out[at] = alphabet[k]
    return "".join(out)


def with_case(model: str, text: str) -> str:
    """text with capitals where model has them (both of one length)."""
    return "".join(t.upper() if m.isupper() else t for m, t in zip(model, text, strict=True))


def with_digits(model: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in model)


def luhn(digits: str) -> int:
    """The check digit for digits."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return -total % 10


# ---------------------------------------------------------------- surrogates by type
def email(s: str, key: bytes) -> str:
    """Local part and host names; the last two labels stay only if they are reserved for examples."""
    low = s.lower()
    labels = low.partition("@")[2].split(".")
    fixed = 2 if labels[-2] == "example" else 1
    cut = len(low) - len(".".join(labels[-fixed:])) - 1  # at a dot, or at the @
    return with_case(s, permute_classes(low[:cut], key, b"email" + low[cut:].encode()) + low[cut:])


#: Prefixes (value, bits) whose addresses stay among themselves, the longest first; all others are one more range.
IP6_RANGES = ((0x20010DB8, 32), (0xFE80 >> 6, 10), (0xFF, 8), (0xFC >> 1, 7), (1, 3))


def ip6_number(s: str) -> int | None:
    try:
        return int(ipaddress.IPv6Address(s))
    except ValueError:
        return None


def ip6(s: str, key: bytes) -> str:
    """Within the range it comes from; written in the short form."""
    value, size = ip6_number(s), 128
    for prefix, bits in IP6_RANGES:
        low, n = prefix << size - bits, 1 << size - bits
        if low <= value < low + n:
            break
    else:
        low, n, bits = 0, 1 << size, 0
    within = [(p << size - b, 1 << size - b) for p, b in IP6_RANGES if b > bits and low <= p << size - b < low + n]
    if not bits:  # ranges in ranges count once
        within = [r for r in within if not any(o != r and o[0] <= r[0] < o[0] + o[1] for o in within)]
    within.sort()
    value = permute(value - low - sum(k for at, k in within if at < value), n - sum(k for _, k in within), key, b"ip6-%d-%d" % (low, bits)) + low
    for at, k in within:
        if value >= at:
            value += k
    new = str(ipaddress.IPv6Address(value))
    return new.upper() if s.isupper() else new


def ip(s: str, key: bytes) -> str:
    """Within the private or shared range it comes from, else among all others."""
    if ":" in s:
        return ip6(s, key)
    value = int.from_bytes(bytes(map(int, s.split("."))), "big")
    ranges = ((10 << 24, 1 << 24), (127 << 24, 1 << 24), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16))
    for low, n in ranges:
        if low <= value < low + n:
            value = low + permute(value - low, n, key, b"ip%d" % low)
            break
    else:
        below = sum(n for low, n in ranges if low < value)
        value = permute(value - below, (1 << 32) - sum(n for _, n in ranges), key, b"ip")
        for low, n in ranges:  # ascending
            if value >= low:
                value += n
    return ".".join(map(str, value.to_bytes(4, "big")))


def card(s: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", s)
    head, check = digits[:-1], int(digits[-1])
    new = permute_classes(head, key, b"card")
    return with_digits(s, new + str((luhn(new) + check - luhn(head)) % 10))


#: Country codes of two digits.
CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(s: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", s)
    if s[0] == "+":  # country codes are free of prefixes
        keep = 1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3
    else:
        keep = max(0, len(digits) - 10)
    return with_digits(s, digits[:keep] + permute_classes(digits[keep:], key, b"phone"))


def iban(s: str, key: bytes) -> str:
    """Country kept; the account is permuted, and the check digits keep their validity (modulo 97);
    those that no account has (00, 01, 99) stay, so that distinct mentions stay distinct."""
    plain = s.replace(" ", "")
    number = lambda x: int("".join(str(int(ch, 36)) for ch in x))
    old = number(plain[4:] + plain[:4]) % 97
    body = permute_classes(plain[4:], key, b"iban" + plain[:2].encode())
    check = (old - number(body + plain[:2] + "00")) % 97
    check = plain[2:4] if plain[2:4] in ("00", "01", "99") else f"{check if check > 1 else check + 97:02d}"
    new = plain[:2] + check + body
    it = iter(new)
    return "".join(ch if ch == " " else next(it) for ch in s)


def ssn(s: str, key: bytes) -> str:
    return permute_classes(s, key, b"ssn")


def hexadecimal(s: str, key: bytes) -> str:
    new = "".join(f"{permute(int(part, 16), 16 ** len(part), key, t):0{len(part)}x}" for part, t in blocks(s.lower(), b"hex%d" % len(s)))
    return new.upper() if s.isupper() else new


def secret(s: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", s):
        return hexadecimal(s, key)
    return permute_classes(s, key, b"secret")


def script(s: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", s) else "greek" if re.search(r"[Ͱ-Ͽ]", s) else "latin"


@lru_cache(4096)
def spell(word: str, key: bytes) -> str:
    """A word in small letters -> another of its length, with vowels for vowels and consonants for
    consonants, marked for marked; other characters stay. A permutation of the words of one shape."""
    out = []
    for part, t in blocks(word, b"name"):
        where = [(at, next((k for k, x in enumerate(NAME_LETTERS) if ch in x), None)) for at, ch in enumerate(part)]
        where = [(at, k) for at, k in where if k is not None]
        value, n = 0, 1
        for at, k in where:
            value = value * len(NAME_LETTERS[k]) + NAME_LETTERS[k].index(part[at])
            n *= len(NAME_LETTERS[k])
        shape = list(part)
        for at, k in where:
            shape[at] = chr(0xE000 + k)
        new = list(part)
        value = permute(value, n, key, t + "".join(shape).encode()) if n > 1 else value
        for at, k in reversed(where):
            value, x = divmod(value, len(NAME_LETTERS[k]))
            new[at] = NAME_LETTERS[k][x]
        out.append("".join(new))
    return "".join(out)


def name_parts(s: str) -> list[tuple[str, bool]]:
    """The words of a name that are replaced, and whether each is a given name; the last one is the
    family's, and so is one that stands alone."""
    words = [w for w in re.split(r"[ .]+", s) if w]
    words = [w for w in words[:-1] if not is_particle(w)] + words[-1:]
    return [(w, k < len(words) - 1) for k, w in enumerate(words)]


def is_particle(word: str) -> bool:
    """Whether a word that is not a name's last is a particle, which stays."""
    return word in PARTICLES or word in CAPITAL_PARTICLES


def part_surrogate(word: str, given: bool, gender: str, key: bytes) -> str:
    new = with_case(word, spell(word.lower(), key))
    ending = ENDINGS[script(word)][gender] if given and len(word) > 1 else ""
    return new + (ending.upper() if len(word) > 1 and word.isupper() else ending)


def name(s: str, gender: str, key: bytes) -> str:
    """A surrogate for each part of the name, in the places of the parts."""
    parts, end = iter(name_parts(s)), len(s.rstrip(" ."))
    return re.sub(r"[^ .]+", lambda m: m[0] if m.end() < end and is_particle(m[0]) else part_surrogate(*next(parts), gender, key), s)


def mentions(text: str, found: list[tuple[str, int, int, str]]):
    """(start, end, word, given, gender) of the words outside found that are parts of names in it."""
    known: dict[str, tuple[bool, str]] = {}
    for kind, start, end, gender in found:
        if kind == "name":
            for word, given in name_parts(text[start:end]):
                if len(word) > 2 and (word.lower() not in known or not given):
                    known[word.lower()] = (given, gender)
    if not known:
        return
    spans = iter([*[(start, end) for _, start, end, _ in found], (len(text), len(text))])
    start, end = next(spans)
    for m in PART.finditer(text):
        while end <= m.start() and start < len(text):
            start, end = next(spans)
        if m.end() <= start and (hit := known.get(m[0].lower())) is not None:
            yield m.start(), m.end(), m[0], *hit


def find(text: str):
    """(type, start, end, gender) of each entity, in order; no two overlap."""
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["name"]:
            which = m["which"]
            yield "name", *m.span("name"), next(g for g, group in TITLES.items() if which in group)
        elif m["value"]:
            yield "secret", *m.span("value"), ""
        else:
            kind = next(k for k in ("email", "ip", "card", "iban", "ssn", "phone", "hex", "ip6", "pan", "tel") if m[k])
            digits = re.sub(r"\D", "", m[0])
            if kind == "pan" and luhn(digits[:-1]) != int(digits[-1]) or kind == "ip6" and not ip6_number(m[0]):
                continue
            kind = {"ip6": "ip", "pan": "card", "tel": "phone"}.get(kind, kind)
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            yield kind, *m.span(), ""


MAKE = {"email": email, "ip": ip, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "hex": hexadecimal, "secret": secret}


def replace(text: str | None, key: bytes = KEY) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and for each its type, place in the new text and wording."""
    if not text or not HINT.search(text):
        return text, []
    out, made, at, shift = [], [], 0, 0
    found = list(find(text))
    new_text = [(start, end, kind, name(text[start:end], gender, key) if kind == "name" else MAKE[kind](text[start:end], key)) for kind, start, end, gender in found]
    new_text += [(start, end, "name", part_surrogate(word, given, gender, key)) for start, end, word, given, gender in mentions(text, found)]
    for start, end, kind, new in sorted(new_text):
        out += [text[at:start], new]
        made.append({"type": kind, "start": start + shift, "end": start + shift + len(new), "surrogate": new})
        shift += len(new) - (end - start)
        at = end
    return "".join([*out, text[at:]]), made


# ---------------------------------------------------------------- operators
def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, text, n_entities, entities (type, start, end in the new
    text, surrogate). A null text stays null without entities; null doc_ids and repeated rows stay
    rows of their own; more columns of docs are not returned."""

    def run(batches):
        for batch in batches:
            found = [replace(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([len(e) for _, e in found], pa.int32()), pa.array([e for _, e in found], ENTITIES)],
                ["doc_id", "text", "n_entities", "entities"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, RESULT)


ENTITIES = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def replace_texts(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with surrogates in the column text, all columns kept, whatever their names. A null or
    empty text stays as it is; repeated rows stay and get equal texts; an empty table gives an empty
    result."""
    at = next(k for k, n in enumerate(docs.columns) if n.lower() == "text")
    docs = docs.select(*[F.col(f"`{n}`").cast("string").alias(n) if k == at else F.col(f"`{n}`") for k, n in enumerate(docs.columns)])

    def run(batches):
        for batch in batches:
            new = pa.array([replace(t, key)[0] for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Surrogates in all documents."""
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
