"""Secret scans: fixed formats, and strings that a primed compressor finds new.

The fixed formats (assignments to secret names, access keys, long hex) are found by their patterns. Beside them every long
string that stands near a sensitive word is measured: the bytes by which it lengthens the compressed form of the code
around it, the compressor being primed with a dictionary of identifiers in all the cases in which code writes them. A
string costing nearly what random characters cost is reported as ``novel``; :func:`separation` measures how well the
threshold tells random strings from identifiers.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.arrow import map_rows, map_texts

KINDS = ("assign", "access", "hex", "novel")
#: Patterns of the known formats; the longest forms of them that are too short to report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Strings to measure, and the words near which they are measured.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|BEGIN [A-Z ]{0,40}KEY", re.I | re.A)
#: Identifiers and words of ordinary code and configuration: what the compressor knows before it sees a text.
IDENTIFIERS = (
    "abstract argument array assert async authorization await basic bearer boolean buffer bytes callback catch certificate char class client "
    "commit config configuration connection const constructor container content context continue controller cookie count create credentials "
    "database datetime debug decode default define delete dependency deploy description dictionary directory document element encode encoding "
    "endpoint environment error event example exception execute export extends false field filename filter final float format framework from "
    "function generate getElementById global handler hash header headers host http https identifier implements import include index info "
    "initialize input instance integer interface internal iterator javascript json key kubernetes label lambda language length library license "
    "listener local localhost logger login main manager mapping message metadata method middleware module namespace network node null number "
    "object offset operator option options output override package parameter parser password path pattern payload permission placeholder "
    "pointer policy private process production profile project promise property protected protocol provider public python query queue random "
    "readme record recursive reference register registry release repository request require resource response result return role route runtime "
    "schema scope secret select sequence server service session setting signature source static status storage stream string struct submit "
    "subscription super switch table template temporary terminal test thread throw timeout timestamp token transaction transform true tuple "
    "type undefined unicode union update upload url user username utf-8 utils validate value variable vector version virtual void volume "
    "webhook while window worker workflow workspace write xml yaml account active address admin after all amount another app application auth "
    "available back base before begin body box build button byte cache call card cell center change channel check child clear click close cloud "
    "code color column command common component condition copy core current custom customer data date day debug device dialog domain done down "
    "draft draw driver edit email empty enabled end entry equal external family fast feature feed fetch field find first flag folder footer form "
    "found from full get global grid group guest has height help hidden history home icon id image init inner input insert is item job label last "
    "layer left legacy level limit line link load lock log long lookup loop machine mail main make map mark master match max media member memory "
    "menu message mime min mode month more move my name native new next node note old one open order other outer owner page pair panel parent part "
    "payment people person phone picture place plan point pool port post previous price primary print priority process product progress public "
    "rate raw read ready recent refresh remote remove render reply reset resolve restore retry right root row rule run safe sample save scan "
    "screen script search secondary security send set shared short show shutdown side sign simple single size sort space special stack start "
    "state step stop store strict style sub sum sync system tab tag target task temp text time title to tool total trace track trial trigger "
    "two unique unit unknown until up use user valid variant view visible wait web width with word wrapper your zone"
)
#: Placeholders and alphabets that stand where secrets should.
PLACEHOLDERS = "your_api_key_here your-token-here insert_secret_here changeme example_token xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 ******************************** 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dictionary() -> bytes:
    """What primes the compressor: every word as it stands in snake, camel and constant case, the commonest form last."""
    words = list(dict.fromkeys(IDENTIFIERS.split()))
    return " ".join((PLACEHOLDERS, "-".join(words), "_".join(w.upper() for w in words), "".join(w[:1].upper() + w[1:] for w in words), "_".join(words))).encode()


class Novelty:
    """Marginal compressed bytes for each character of a candidate, above what the code around it and identifiers explain."""

    def __init__(self, dictionary: bytes, level: int = 9):
        import zstandard

        prime = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=prime, write_content_size=False, write_checksum=False).compress

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around, new = (before + after).encode(), candidate.encode()
        return (len(self.compress(around + b"\n" + new)) - len(self.compress(around + b"\n"))) / len(new)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known formats, in code points; leftmost matches of each kind, too short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, least: float, near: int, around: int) -> list[tuple[int, int, str]]:
    """Incompressible strings within ``near`` characters before or after a sensitive word, outside the base spans.

    Strings are cut where a sensitive word stands in them. Words and strings are each found once, in time that grows with
    the text.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken: list[list[int]] = []
    for a, b, _ in base:  # sorted by start; joined where they overlap
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out = []
    for m in CANDIDATE.finditer(text):
        i, k = m.start(), bisect_right(ends, m.start())
        while True:
            j = min(m.end(), starts[k]) if k < len(words) else m.end()
            if j - i >= LEAST and ((k and i - ends[k - 1] <= near) or (k < len(words) and starts[k] - j < near)):
                t = bisect_left(taken, [j]) - 1
                if (t < 0 or taken[t][1] <= i) and novelty(text[max(0, i - around) : i], text[i:j], text[j : j + around]) >= least:
                    out.append((i, j, "novel"))
            if k == len(words) or ends[k] >= m.end() or starts[k] >= m.end():
                break
            i, k = ends[k], k + 1
    return out


def separation(least: float, seed: int = 11, n: int = 1000) -> tuple[float, float]:
    """Share of random strings (16 to 40 of base62 or URL-safe base64) that are reported, and of identifiers that aren't.

    Identifiers are two to five words in snake, camel, kebab or constant case, some with a number, half of their words
    not in the dictionary.
    """
    rng, novelty = random.Random(seed), Novelty(dictionary())
    known = IDENTIFIERS.split()
    syllables = ("ta", "ren", "lo", "mi", "ver", "son", "ca", "del", "por", "ti", "na", "gra", "ble", "ous", "ship", "ing")
    around = ("config = load()\nauthorization: ", "\nreturn response\n")

    def identifier() -> str:
        words = [rng.choice(known) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(2, 5))]
        case = rng.randrange(4)
        out = ("_".join(words), words[0] + "".join(w[:1].upper() + w[1:] for w in words[1:]), "-".join(words), "_".join(words).upper())[case] + rng.choice(("", "", "1", "2", "64"))
        return out if len(out) >= LEAST else identifier()

    def secret() -> str:
        return "".join(rng.choice(string.ascii_letters + string.digits + rng.choice(("", "-_"))) for _ in range(rng.randint(16, 40)))

    score = lambda x: novelty(around[0], x, around[1])
    return sum(score(secret()) >= least for _ in range(n)) / n, sum(score(identifier()) < least for _ in range(n)) / n


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.95, near: int = 60, around: int = 400, mask: str = "<secret>") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, redacted`` for each row of ``df``.

    ``redacted`` is the text with every span (overlapping ones joined) replaced by ``mask``; null if there is none to
    replace. Strings of 16 characters or more that stand within ``near`` characters of a sensitive word are measured
    against ``around`` characters on either side, and reported from ``least`` compressed bytes for each of theirs on. A
    null or empty text has no spans; very long ones take time in proportion. Rows are judged one by one, so repeated rows,
    ids and ties change nothing; an empty table stays empty; other columns are not read. No shuffle.
    """

    def make():
        novelty = Novelty(dictionary())

        def work(ids, texts):
            base = [base_spans(t) for t in texts]
            novel = [novel_spans(t, b, novelty, least, near, around) for t, b in zip(texts, base)]
            count = lambda kind: [sum(s[2] == kind for s in b) for b in base]
            return {
                "doc_id": ids,
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "n_novel": [len(n) for n in novel],
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(b + n) for b, n in zip(base, novel)],
                "redacted": [redact(t, b + n, mask) if b or n else None for t, b, n in zip(texts, base, novel)],
            }

        return work

    kind = df.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    return map_texts(df, id_col, text_col, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string", make)


def redact(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", least: float = 0.95, near: int = 60, around: int = 400, mask: str = "<secret>") -> DataFrame:
    """The rows of ``df``, all columns as they are but for the text, whose secret spans are replaced by ``mask``."""

    def make():
        novelty = Novelty(dictionary())

        def clean(t: str | None) -> str | None:
            if not t:
                return t
            base = base_spans(t)
            spans = base + novel_spans(t, base, novelty, least, near, around)
            return redact(t, spans, mask) if spans else t

        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            columns = rows.columns
            columns[place] = pa.array([clean(t) for t in texts.to_pylist()], texts.type)
            return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

        return work

    place = df.columns.index(text_col)
    return map_rows(df, text_col, make)
