"""Surrogates for personal data, by keyed permutations of each entity's own format.

Detected entities are e-mail and IP addresses, phone, card, social security and bank numbers, secrets,
names after a title, listed first names before a capitalised word, and every other mention of a found name's
words in the same text, unless an article stands before it ("the White House"). A card number has 13 to 19 digits in a row or in
a card's groups, a first digit and a check digit of cards: number lists, dates and order numbers are none. An entity is read as a number in the mixed radix of its characters (digits, letters of
one alphabet), which a keyed permutation without fixed points maps to another number of the same format. So a
surrogate keeps type, length, script, case, separators and check digits; equal entities get equal surrogates
in every document, in whatever notation they are written (coreference), and different ones get different ones.
Names from the fixed lists are permuted within their gender's list; other names keep vowels, consonants and
their ending.

A check over the whole corpus counts originals per surrogate; should two meet, or an entity keep its value,
the key's version is raised and the check repeated, so distinctness never rests on the construction alone.

Defined results: null texts stay null and empty ones empty; texts without entities are unchanged. One letter repeated is
no secret unless a word such as `password=` stands before it. Columns named
like an output column are replaced, all others are kept. Repeated rows are treated alike, an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from residua.operators.storage import materialize

# Titles by gender, and first names by gender.
TITLES = {
    "m": r"Mr\.?|Herr|M\.|Monsieur|Sr\.|Señor", "f": r"Mrs\.?|Ms\.?|Miss|Frau|Mme\.?|Madame|Mlle|Sra\.|Señora|Doña", "n": r"Dr\.?|Prof\.?",
}
FIRST_NAMES = {
    "m": "James John Robert Michael William David Thomas Peter Paul Daniel Hans Karl Jean Pierre Louis José Juan Carlos Luis Miguel",
    "f": "Mary Anna Linda Sarah Laura Emma Julia Maria Sophie Claire Marie Jeanne Ingrid Heike Ursula Carmen Isabel Lucía Elena Ana",
}
FIRST = [name for names in FIRST_NAMES.values() for name in names.split()]
#: Capitalised words that say nothing of a name, so they are no mention of one.
COMMON = set((
    "The A An And But Or If In On At To Of For From By With He She It They We You His Her Their Its This That These Those When Where Who What Why How "
    "As Is Was Are Were Not No Yes After Before Then There Here Der Die Das Und Ein Eine Er Sie Es Le La Les Un Une Et Il Elle El Los Las"
).split())
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Alphabets a character is exchanged within; other letters are exchanged within their block of 16 letters of one case.
ALPHABETS = [DIGITS, LOWER, "áéíóúàèìòùâêîôûäëïöü"]
ROUNDS = 6
#: Letters that are exchanged as one number; longer entities go block by block.
BLOCK = 64
#: Words before a capitalised word that make it no mention of a person.
ARTICLES = "the The der Der die Die das Das le Le la La les Les el El los Los las Las".split()

EMAIL = r"[\w.%+\-]+@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,}"
_GROUPS = ["".join(group.replace("|", sep) for group in form) for sep in (" ", "-") for form in (
    [r"\d{4}", r"|\d{4}" * 3, r"(?:|\d{1,3})?"], [r"\d{4}|\d{6}|\d{4,5}"],
)]
KINDS = {
    "email": r"(?<![\w.%+\-])" + EMAIL,
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|(?<![0-9A-Za-z])(?!(?:a+|b+|c+|d+|e+|f+)(?![0-9A-Za-z]))[0-9a-f]{32,}(?![0-9A-Za-z])"
              r"|(?i:(?<=token = \")|(?<=token=)|(?<=password=)|(?<=password: )|(?<=api_key=)|(?<=secret=))[^\s\"']{8,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w.])(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|\+(?!1\D)\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}"
             r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
             r"|0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})|(?:\(0\d{2,4}\) ?|0[1-9]\d{1,3}[ /\-])\d{5,8})(?!\w|[.\-]\d)",
    "card": r"(?<![\w.])(?<!\d[ \-])(?:\d{13,19}|" + "|".join(_GROUPS) + r")(?![\w]|[ \-]\d)",
    "name": "".join((r"(?<!\w)(?:(?:", "|".join(TITLES.values()), r") (?:[A-ZÀ-ÖØ-Þ][\w'’\-]+)(?: [A-ZÀ-ÖØ-Þ][\w'’\-]+){0,2}"
                     r"|(?:", "|".join(FIRST), r")(?: [A-ZÀ-ÖØ-Þ][\w'’\-]+){1,2})")),
}
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS.items()))
_EMAIL_HERE = re.compile(EMAIL).match
#: What every match of KINDS holds, so a text without any of these has no entity (the tests hold both together). One by one
#: these are several times faster than as alternatives of one pattern.
HINTS = [re.compile(p) for p in (
    r"@", r"AKIA", r"gh[pousr]_", r"[0-9a-f]{32}", r"[nNdDyYtT](?:=| = |: )",  # email, secret
    r"\d(?:\d\d|\.\d)", r"\+\d", r"0\d[ .\-]\d\d[ .\-]\d", r"[A-Z]{2}\d{2}",  # ssn, phone and card, ip; phones; iban
    "(?:" + "|".join([*TITLES.values(), *FIRST]) + r") [A-ZÀ-ÖØ-Þ]",
)]


class Permutation:
    """Keyed permutations without fixed points of the numbers below any size."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple, int] = {}

    def _round(self, i: int, tweak: str, value: int) -> int:
        text = f"{i}|{tweak}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    def _walk(self, value: int, size: int, tweak: str, back: bool) -> int:
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:  # leave the rectangle's surplus by going on
            left, right = divmod(value, b)
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                step = self._round(i, tweak, right if i % 2 else left)
                step = -step if back else step
                left, right = ((left + step) % a, right) if i % 2 else (left, (right + step) % b)
            value = left * b + right
            if value < size:
                return value

    def next(self, value: int, size: int, tweak: str) -> int:
        """The number after `value` on one keyed circle through all numbers below `size`."""
        if size < 2:
            return value
        at = (value, size, tweak)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = self._walk((self._walk(value, size, tweak, False) + 1) % size, size, tweak, True)
        return self.known[at]


def alphabet_of(letter: str) -> str | None:
    for alphabet in ALPHABETS:
        if letter in alphabet:
            return alphabet
    if letter.isalpha():
        start = ord(letter) // 16 * 16
        block = [c for c in map(chr, range(start, start + 16)) if c.isalpha() and c == c.lower() and len(c.upper()) == 1]
        return "".join(block) if letter in block else None
    return None


def exchanged(text: str, keyed: Permutation, tweak: str, alphabets: Callable[[int, str], str | None] | None = None) -> str:
    """Exchange all characters of a text within their alphabets; upper case stays in place.

    Up to `BLOCK` letters are one number. What follows is exchanged block by block, each under a tweak made of the
    letters before it, so the whole stays a permutation and its time is linear.
    """
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    sets = [(alphabets(i, c) if alphabets else alphabet_of(c)) for i, c in enumerate(low)]
    out, start, letters, before = [], 0, 0, hashlib.blake2b(digest_size=16)
    for end in range(1, len(text) + 1):
        letters += sets[end - 1] is not None
        if letters == BLOCK or end == len(text):
            here = f"{tweak}|{start}|{before.hexdigest()}" if start else tweak
            out.append(_exchanged_block(text[start:end], low[start:end], sets[start:end], keyed, here))
            before.update("".join(low[start:end]).encode())
            start, letters = end, 0
    return "".join(out)


def _exchanged_block(text: str, low: list[str], sets: list[str | None], keyed: Permutation, tweak: str) -> str:
    value, size, form = 0, 1, []
    for c, letters in zip(low, sets):
        if letters:
            value, size = value * len(letters) + letters.index(c), size * len(letters)
        form.append(letters[0] if letters else c)
    value, out = keyed.next(value, size, tweak + "|" + "".join(form)), []
    for c, letters, old in zip(reversed(low), reversed(sets), reversed(text)):
        if letters:
            value, place = divmod(value, len(letters))
            c = letters[place]
        out.append(c.upper() if old != old.lower() and len(c.upper()) == 1 else c)
    return "".join(reversed(out))


def _refill(form: str, digits: str) -> str:
    """Digits put into the places of a written number's digits."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in form)


def luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _ip(text: str, keyed: Permutation) -> str:
    parts = [int(p) for p in text.split(".")]
    value = int.from_bytes(bytes(parts), "big")
    for prefix, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24)):  # private nets stay what they are
        if value >> bits == prefix >> bits:
            return ".".join(map(str, (prefix | keyed.next(value & ((1 << bits) - 1), 1 << bits, f"ip{prefix}")).to_bytes(4, "big")))
    group = lambda v: 0 if v >> 24 in (0, 10, 127) or v >> 20 == 0xAC1 or v >> 16 == 0xC0A8 else 1 if v >> 24 < 224 else 2
    out = keyed.next(value, 1 << 32, "ip")
    while group(out) != group(value):
        out = keyed.next(out, 1 << 32, "ip")
    return ".".join(map(str, out.to_bytes(4, "big")))


def _name_word(word: str, keyed: Permutation) -> str:
    """A name's word, permuted within its list or, of no list, among the words of its sound that no list holds."""
    names = next((names for names in map(str.split, FIRST_NAMES.values()) if word in names), None)
    if names:
        return names[keyed.next(names.index(word), len(names), "first" + names[0])]
    by_sound = lambda n, c: (
        None if n == len(word) - 1 else VOWELS if c in VOWELS else CONSONANTS if c in CONSONANTS else alphabet_of(c)
    )
    out = exchanged(word, keyed, "name", by_sound)
    while out in FIRST:
        out = exchanged(out, keyed, "name", by_sound)
    return out


def _name_words(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(title with its blank or nothing, (word, possessive ending or nothing) of each word) of a name."""
    title, _, rest = text.partition(" ")
    titled = rest and any(re.fullmatch(titles, title) for titles in TITLES.values())
    words = (rest if titled else text).split(" ")
    return title + " " if titled else "", [(w[:-2], w[-2:]) if len(w) > 3 and w[-2:] in ("'s", "’s") else (w, "") for w in words]


def _name(text: str, keyed: Permutation) -> str:
    title, words = _name_words(text)
    return title + " ".join(_name_word(word, keyed) + ending for word, ending in words)


def surrogate(kind: str, text: str, keyed: Permutation) -> tuple[str, str]:
    """(canonical form of the entity, its surrogate in the notation of `text`)."""
    if kind == "email":
        local, _, host = text.rpartition("@")
        labels = host.split(".")
        named = [exchanged(x, keyed, "host") if i < max(1, len(labels) - 2) else x for i, x in enumerate(labels)]
        return text.lower(), exchanged(local, keyed, "local") + "@" + ".".join(named)
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split(".")), _ip(text, keyed)
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        code = re.match(r"\+(\d{1,3})[ .\-(]", text)
        start = len(code[1]) if code else int(digits[0] == "0")  # the 0 that stands for the own country stays
        national = exchanged(digits[start:], keyed, "phone")
        return digits[start:], _refill(text, digits[:start] + national)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        inner = digits[0] + exchanged(digits[1:-1], keyed, "card")
        last = str((luhn(digits) - luhn(inner + "0")) % 10)
        return digits, _refill(text, inner + last)
    if kind == "ssn":
        digits = text.replace("-", "")
        return digits, _refill(text, exchanged(digits, keyed, "ssn"))
    if kind == "iban":
        plain = text.replace(" ", "")
        body = exchanged(plain[4:], keyed, "iban" + plain[:2])
        check = (iban_rest(plain) - iban_rest(plain[:2] + "00" + body)) % 97
        left = iter(plain[:2] + f"{check:02d}" + body)
        return plain, "".join(c if c == " " else next(left) for c in text)
    if kind == "name":
        return text, _name(text, keyed)
    hexadecimal = re.fullmatch(r"[0-9a-f]+", text) is not None
    return text, exchanged(text, keyed, "secret", (lambda i, c: HEX) if hexadecimal else None)


def is_card(text: str) -> bool:
    """First digit and check digit of payment cards, and no row of years."""
    groups = re.split("[ -]", text)
    return text[0] in "23456" and luhn("".join(groups)) == 0 and not all(re.fullmatch("19[0-9]{2}|20[0-9]{2}", g) for g in groups)


def is_entity(kind: str, text: str) -> bool:
    """Rules beyond the pattern."""
    if kind == "card":
        return is_card(text)
    if kind == "ip":
        return all(int(p) < 256 for p in text.split("."))
    if kind == "iban":
        return iban_rest(text.replace(" ", "")) == 1
    return kind != "phone" or 7 <= len(re.sub(r"\D", "", text)) <= 15


def may_hold(text: str) -> bool:
    return any(p.search(text) for p in HINTS)


def entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, without overlaps."""
    if not text or not may_hold(text):
        return
    found = ANY.search(text)
    while found:
        good = is_entity(found.lastgroup, found[0])
        if good:
            yield found.lastgroup, found.start(), found.end()
            at = found.end()
            if rest := _EMAIL_HERE(text, at):  # directly behind an entity
                yield "email", at, rest.end()
                at = rest.end()
        # what was no entity may hold one
        found = ANY.search(text, at if good else found.start() + 1)


def with_mentions(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The entities of a text along with other mentions of its names' words."""
    words = {w for kind, start, end in found if kind == "name" for w, _ in _name_words(text[start:end])[1]} - COMMON
    if not words:
        return found
    out, at = [], 0
    mention = re.compile("".join(rf"(?<!\b{a} )" for a in ARTICLES) + r"(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)")
    for kind, start, end in [*found, ("", len(text), len(text))]:
        out += [("name", m.start(), m.end()) for m in mention.finditer(text, at, min(start + 1, len(text))) if m.end() <= start]
        out += [(kind, start, end)] if kind else []
        at = end
    return out


def replaced(text: str | None, keyed: Permutation) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, canonical form, surrogate's canonical form) of each entity."""
    parts, found, at = [], [], 0
    for kind, start, end in with_mentions(text or "", list(entities(text))):
        original, new = surrogate(kind, text[start:end], keyed)
        parts += [text[at:start], new]
        found.append((kind, original, surrogate(kind, new, keyed)[0]))
        at = end
    return ("".join([*parts, text[at:]]) if found else text), found


def _keyed(key: str, version: int) -> Permutation:
    return Permutation(f"{key}#{version}".encode())


def entity_table(df: DataFrame, key: str, version: int = 0, text: str = "text") -> DataFrame:
    """Distinct entities of the corpus with their surrogates, both in canonical form, and how often they occur."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = _keyed(key, version)
        for batch in rows:
            found = [e for value in batch.column(0) for e in replaced(value.as_py(), keyed)[1]]
            columns = [pa.array([e[i] for e in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "original", "surrogate"])

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(batches, "kind string, original string, surrogate string")
    return found.groupBy("kind", "original", "surrogate").agg(F.count("*").alias("n"))


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that several originals share or that equal their original."""
    shared = table.groupBy("kind", "surrogate").agg(F.count("*").alias("originals"), F.max((F.col("original") == F.col("surrogate")).cast("int")).alias("same"))
    return shared.where("originals > 1 or same = 1")


def sound_version(df: DataFrame, key: str, text: str = "text", most: int = 20) -> int:
    """The first version of the key under which the corpus has no collisions."""
    for version in range(most):
        if collisions(materialize(entity_table(df, key, version, text), "entities")).isEmpty():
            return version
    raise ValueError("every version of the key gives colliding surrogates")


def replace_pii(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`df` with surrogates in its text, and `n_entities` and `kinds` (comma-separated, in order of occurrence)."""
    version = sound_version(df, key, text)
    plain = df.drop("n_entities", "kinds").withColumn(text, F.col(text).cast("string"))
    schema = StructType([*plain.schema.fields, StructField("n_entities", IntegerType()), StructField("kinds", StringType())])
    place = plain.columns.index(text)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = _keyed(key, version)
        for batch in rows:
            done = [replaced(value.as_py(), keyed) for value in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([len(f) for _, f in done], pa.int32()), pa.array([",".join(e[0] for e in f) for _, f in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_entities", "kinds"])

    return plain.mapInArrow(batches, schema)
