"""Surrogates for personal data: keyed, type-consistent replacements.

Every detected entity is replaced by an image of itself under a keyed permutation of the strings of its own format: equal
entities keep one surrogate in all documents (coreference), different ones never share one (distinctness), and length,
case, punctuation, script and, for given names in a list, gender stay. Names are found behind a title or where a listed
given name is followed by capitalised words, and in the same text wherever the name, or its last word, stands again; names
that are never introduced so stay as they are. Mail addresses of one domain keep a common one; network addresses stay in
their private block, or public. Check digits stay valid. No table of entities is kept, so nothing grows with the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left

import regex
from pyspark.sql import DataFrame

from wayfold.llm.arrow import map_texts

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "name")
#: Patterns of the entities, earlier kinds first where they overlap.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[\w+-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])", re.A),
    "card": re.compile(r"(?<![\w.+-])[2-6][0-9]{3}(?:([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[ -]?[0-9]{6}[ -]?[0-9]{5})(?!\w|-[0-9])", re.A),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w+])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w|[.-][0-9])|(?<!\w)\+[1-9][0-9]{7,14}(?!\w)", re.A),
    "name": regex.compile(r"(?<!\w)(Mr|Mrs|Ms|Miss|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа|Κύριος|Κυρία)\.? ((?![a-z])\p{L}[\p{L}\p{M}]+(?:[ -](?![a-z])\p{L}[\p{L}\p{M}]+){0,2})"),
}
#: Titles by the gender they tell, and given names by gender, all in natural order.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
GIVEN = {
    "f": ("Alice", "Anna", "Carla", "Charlotte", "Claire", "Diana", "Elena", "Emma", "Hannah", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Olivia", "Paula", "Sofia", "Sophie"),
    "m": ("Adam", "Alex", "Bruno", "Carlos", "Daniel", "David", "Felix", "Hugo", "Ivan", "Jacob", "James", "Julien", "Lucas", "Marco", "Martin", "Oliver", "Oscar", "Paul", "Pedro", "Thomas"),
}
#: Names without a title: a listed given name and one or two capitalised words.
GIVEN_NAME = regex.compile(r"(?<!\w)((?:" + "|".join(sorted((*GIVEN["f"], *GIVEN["m"]), key=lambda n: (-len(n), n))) + r")(?:[ -](?![a-z])\p{L}[\p{L}\p{M}]+){1,2})(?![\w\p{M}])")
#: Address blocks of one kind each (prefix, its bits); the rest is public.
IP_BLOCKS = ((0, 8), (10, 8), (127, 8), (169 << 8 | 254, 16), (172 << 4 | 1, 12), (192 << 8 | 168, 16), (7, 3))
#: Letters of each script, vowels first; letters that are in none of these are permuted within their block of Unicode.
SCRIPTS = (("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"))
#: A last name alone is taken again from so many letters on, from two in scripts without case.
AGAIN = 3


@functools.lru_cache(maxsize=64)
def alphabet(script: str, category: str, page: int) -> str:
    """Letters of one script and category that are single, composed and, if they have a case, change it one to one.

    Those with a case are taken from one page of 256 code points, so that rare marks stay rare; others from the basic plane.
    """

    def fits(c: str) -> bool:
        if unicodedata.category(c) != category or unicodedata.normalize("NFC", c) != c or unicodedata.name(c, "").partition(" ")[0] != script:
            return False
        return category != "Ll" or (len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)

    places = range(max(0x80, page << 8), page + 1 << 8) if category == "Ll" else range(0x80, 0xD7A4)
    return "".join(c for c in map(chr, places) if fits(c) and not any(c in x for pair in SCRIPTS for x in pair))


def class_of(c: str) -> str | None:
    """The alphabet that a lower-case character is permuted in; null if it stays."""
    for a in ("0123456789", *(x for pair in SCRIPTS for x in pair)):
        if c in a:
            return a
    if len(c) == 1 and (kind := unicodedata.category(c)) in ("Ll", "Lo"):
        a = alphabet(unicodedata.name(c, "").partition(" ")[0], kind, ord(c) >> 8 if kind == "Ll" else 0)
        return a if c in a else None
    return None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Permuter:
    """Keyed permutations of numbers below a bound, by a Feistel network that is walked until it lands below the bound."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, tweak: str, value: int, bound: int) -> int:
        if bound < 2:
            return value
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(8):
                mac = hmac.new(self.key, f"{tweak}|{bound}|{r}|{right}".encode(), hashlib.sha256).digest()
                left, right = right, left ^ (int.from_bytes(mac, "little") & mask)
            value = left << half | right
            if value < bound:
                return value

    def digits(self, tweak: str, digits: str) -> str:
        return f"{self.number(tweak, int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""

    def letters(self, tweak: str, letters: str, alphabet: str) -> str:
        """Letters of one alphabet to as many of the same."""
        value = 0
        for c in letters:
            value = value * len(alphabet) + alphabet.index(c)
        value = self.number(tweak, value, len(alphabet) ** len(letters))
        out = []
        for _ in letters:
            value, k = divmod(value, len(alphabet))
            out.append(alphabet[k])
        return "".join(reversed(out))

    def shaped(self, tweak: str, text: str) -> str:
        """Digits, and the vowels and consonants or letters of each script, each among themselves; the rest and the case stay."""
        plain = [c.lower() if len(c.lower()) == 1 else c for c in text]  # each by itself: a final sigma would be another letter
        which = [class_of(c) for c in plain]
        classes = sorted({a for a in which if a})
        shape = tweak + "|" + ",".join("." if a is None else str(classes.index(a)) for a in which) + "|" + "".join(a[0] for a in classes)
        made = {}
        for k, a in enumerate(classes):
            mine = "".join(c for c, w in zip(plain, which) if w == a)
            made[a] = iter(self.digits(f"{shape}|{k}", mine) if a[0] == "0" else self.letters(f"{shape}|{k}", mine, a))
        out = [c if w is None else next(made[w]) for c, w in zip(text, which)]
        return "".join(n.upper() if c.isupper() else n for n, c in zip(out, text))


class Surrogates:
    def __init__(self, key: bytes):
        self.permuter = Permuter(key)
        self.known: dict[tuple[str, str], str] = {}

    def of(self, kind: str, entity: str) -> str:
        if (kind, entity) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[kind, entity] = getattr(self, f"_{kind}")(entity)
        return self.known[kind, entity]

    def _email(self, s: str) -> str:
        own, _, domain = s.lower().rpartition("@")
        domain, _, top = domain.rpartition(".")
        return f"{self.permuter.shaped('email', own)}@{self.permuter.shaped('domain', domain)}.{top}"

    def _phone(self, s: str) -> str:
        lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", s)
        at = lead.end() if lead else 0
        return s[:at] + self.permuter.shaped("phone", s[at:])

    def _ssn(self, s: str) -> str:
        while True:
            s = self.permuter.shaped("ssn", s)
            if PATTERNS["ssn"].fullmatch(s):
                return s

    def _iban(self, s: str) -> str:
        return s[:2] + self.permuter.shaped("iban", s[2:])

    def _ip(self, s: str) -> str:
        value = int.from_bytes(bytes(map(int, s.split("."))), "big")
        block = lambda v: next(((p, n) for p, n in IP_BLOCKS if v >> (32 - n) == p), None)
        if kind := block(value):
            p, n = kind
            value = p << (32 - n) | self.permuter.number(f"ip{p}/{n}", value & ((1 << (32 - n)) - 1), 1 << (32 - n))
        else:
            value = self.permuter.number("ip", value, 1 << 32)
            while block(value):
                value = self.permuter.number("ip", value, 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _card(self, s: str) -> str:
        digits = re.sub(r"\D", "", s)
        valid, made = luhn(digits), digits
        while True:
            made = digits[0] + self.permuter.digits(f"card{digits[0]}", made[1:])
            if luhn(made) == valid:
                break
        out = iter(made)
        return "".join(next(out) if c.isdigit() else c for c in s)

    def _name(self, s: str) -> str:
        words = unicodedata.normalize("NFC", s)
        out = []
        for w in re.split(r"([ -])", words):
            listed = next((g for g in GIVEN if w in GIVEN[g]), None)
            if listed:
                out.append(GIVEN[listed][self.permuter.number(f"given{listed}", GIVEN[listed].index(w), len(GIVEN[listed]))])
            else:
                made = w
                while True:  # a made-up word is none of the lists
                    made = self.permuter.shaped("name", made)
                    if made not in GIVEN["f"] and made not in GIVEN["m"]:
                        break
                out.append(made)
        return "".join(out)


class Taken:
    """Spans that don't overlap, in order; a query takes logarithmic time."""

    def __init__(self):
        self.starts: list[int] = []
        self.found: list[tuple[int, int, str, str]] = []

    def add(self, a: int, b: int, kind: str, entity: str) -> bool:
        k = bisect_left(self.starts, b)
        if k and self.found[k - 1][1] > a:
            return False
        self.starts.insert(k, a)
        self.found.insert(k, (a, b, kind, entity))
        return True


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity in normal form), not overlapping, in order; earlier kinds first where they overlap."""
    taken = Taken()
    names: dict[str, None] = {}

    def name(a: int, words: str) -> None:
        if taken.add(a, a + len(words), "name", normal("name", words)):
            names[words] = None

    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                name(m.start(2), m.group(2))
            else:
                taken.add(*m.span(), kind, normal(kind, m.group()))
    for m in GIVEN_NAME.finditer(text):
        words = re.split(r"([ -])", m.group(1))
        while len(words) > 1 and not words[-1][0].isupper():
            words = words[:-2]
        if len(words) > 1:
            name(m.start(), "".join(words))
    if names:  # the names again, and their last words
        again = dict(names)
        for full in names:
            last = re.split(r"[ -]", full)[-1]
            if len(last) >= (AGAIN if last[0].isupper() else 2):
                again[last] = None
        listed = sorted(again, key=lambda n: (-len(n), n))
        for low in range(0, len(listed), 1000):
            some = "|".join(map(re.escape, listed[low : low + 1000]))
            for m in regex.finditer(rf"(?<!\w)(?:{some})(?![\w\p{{M}}])", text):
                taken.add(*m.span(), "name", normal("name", m.group()))
    return taken.found


def normal(kind: str, entity: str) -> str:
    """What tells entities of one kind apart: case not in mail addresses, composition not in names."""
    return entity.lower() if kind == "email" else unicodedata.normalize("NFC", entity) if kind == "name" else entity


def replaced(text: str, found: list[tuple[int, int, str, str]], surrogates: Surrogates) -> tuple[str, int]:
    """The text with surrogates, and how many of these equal an entity of the text as it was.

    Permutations keep different entities of a format apart. Should two of different formats meet, the later one is
    permuted on until it is free.
    """
    out, at, clashes = [], 0, 0
    real = {text[a:b] for a, b, _, _ in found}
    made: dict[str, str] = {}
    mine: dict[tuple[str, str], str] = {}
    for a, b, kind, entity in found:
        if (kind, entity) not in mine:
            new = surrogates.of(kind, entity)
            for _ in range(100):
                if made.setdefault(new, entity) == entity:
                    break
                new = surrogates.of(kind, new)
            mine[kind, entity] = new
        new = mine[kind, entity]
        clashes += new in real
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], clashes


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_<kind>...`` for each kind, ``n_clashes, spans, text`` for each row of ``df``.

    ``text`` has the surrogates (the text itself where nothing is found, empty for null); ``spans`` are kind:start:end in
    code points of the original; ``n_clashes`` counts surrogates that equal an entity of the original text. ``key`` is the
    secret of the permutations: who has it can undo them. Rows are worked on one by one: repeated rows, ids and ties get
    equal results, an empty table none; a very long text takes time in proportion to its length and names. Other columns
    are not read. No shuffle.
    """

    def make():
        surrogates = Surrogates(key)

        def work(ids, texts):
            found = [entities(t) for t in texts]
            new = [replaced(t, f, surrogates) if f else (t, 0) for t, f in zip(texts, found)]
            out = {"doc_id": ids, "n_clashes": [n for _, n in new], "text": [t for t, _ in new]}
            out |= {f"n_{k}": [sum(e[2] == k for e in f) for f in found] for k in KINDS}
            return out | {"spans": [",".join(f"{k}:{a}:{b}" for a, b, k, _ in f) for f in found]}

        return work

    kind = df.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(df, id_col, text_col, f"doc_id {kind}, {counts}, n_clashes long, spans string, text string", make)
