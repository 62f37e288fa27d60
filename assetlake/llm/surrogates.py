"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by pattern: e-mail and IPv4 addresses, payment card numbers with a valid check digit, telephone
numbers (international ones behind + or 00, and the national forms of the languages here), quoted or assigned
hexadecimal secrets, and names after a title (README has the limits). Each is brought to a canonical form
(lower case, digits only ...). One keyed hash of type, canonical form and attempt gives a canonical surrogate, so
the same entity has the same surrogate everywhere; every mention is then written in its own format (case and
punctuation of the original, check digit recomputed, gender by the title, script letter by letter).

Distinctness is checked over the whole corpus: all distinct entities get a surrogate, those that meet another
surrogate or a real entity try again with the next attempt, until none is left. Only texts with a digit, an at sign
or a title are looked at and joined with their surrogates; the others pass as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import fresh
from assetlake.session import materialize, materialize_counted

#: Titles and the gender they tell. Fixed values.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f",
    "господин": "m", "госпожа": "f",
}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
#: What a text must hold to be looked at; every pattern below needs one of these.
CANDIDATE = rf"[0-9@]|\b({_TITLE})\b"

#: What may stand between two digits of a telephone number.
_GAP = r"(?:[ \u00a0\u202f]?[()/\u2010-\u2013-]{1,2}[ \u00a0\u202f]?|[ \u00a0\u202f]{1,2}|\.)?"
_NATIONAL = r"(?<!\d[.,/-])"
#: A card-shaped run with a wrong check digit is no telephone number either.
_NO_CARD = r"(?!\d{16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d)"
_PHONE = "|".join([
    # Behind a plus or 00. Where the length is known, digits that follow belong to something else; else 7 to 15 digits,
    # but no plain number with a sign (seven digits without gaps, thousands, a decimal fraction).
    rf"(?:\+|{_NO_CARD}(?P<zeros>00[ \u00a0\u202f]?))(?:1(?:{_GAP}\d){{10}}|3[34](?:{_GAP}\(0\))?(?:{_GAP}\d){{9}}"
    rf"|44(?:{_GAP}\(0\))?(?:{_GAP}\d){{9,10}}"
    rf"|(?!\d{{7}}(?!{_GAP}\d)|\d{{1,2}}([ .])\d{{3}}\2\d{{3}}(?!{_GAP}\d)|\d\.\d+(?!{_GAP}\d))[1-9](?:{_GAP}\d){{6,14}})(?!\w)",
    # French; then German and British with an area code, or in one piece.
    rf"{_NATIONAL}0[1-9]([ .\u00a0\u202f-]?)\d\d(?:\3\d\d){{3}}(?!\w)",
    rf"{_NATIONAL}{_NO_CARD}(?:\(0[1-9]\d{{1,4}}\) ?|0[1-9]\d{{1,4}}(?: ?[/\u2010-\u2013-] ?|[ \u00a0]))(?:[ \u00a0-]?\d){{5,9}}(?!\w)",
    rf"{_NATIONAL}0[1-9]\d{{8,10}}(?!\w)",
    # Spanish: three threes (not with dots, which part thousands), or pairs at the end.
    r"(?<!\d[ .,/-])(?:[6-9]\d\d([ -])\d{3}\4\d{3}|[6-9]\d\d([ .-])\d\d\5\d\d\5\d\d|[89]\d([ .-])\d{3}\6\d\d\6\d\d)(?![ .,-]?\d)(?!\w)",
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?!\d)",
    # North American in one piece.
    r"(?<![.,/=&#-])[2-9]\d{2}[2-9]\d{6}(?!\w)",
    r"\+\d{8,15}(?!\d)",
])
PHONE = re.compile(rf"(?=[+(\d])(?<![\w+])(?:{_PHONE})")
#: Calling codes: those of one and two digits, all others have three. Fixed values.
CODE = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")

#: Words inside a name that are no names themselves. Fixed values.
PARTICLES = ["von", "van", "zu", "de", "del", "du", "di", "da", "dos", "des", "la", "las", "los", "der", "den", "dem"]
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES[:10])})(?:[^\S\n]+(?:{'|'.join(PARTICLES[10:])}))?[^\S\n]+|d['’](?=[^\W\d_]))"
_LETTERS = r"(?:[^\W\d_][\u0300-\u036f]*)+"
_JOINT = r"['’ʼ\u2010\u2011-]"
_WORD = rf"{_LETTERS}(?:{_JOINT}{_LETTERS})*"
#: After a title: white space with one line break at most, academic titles and particles.
_BEFORE = rf"(?:[^\S\n]+\n?|\n)[^\S\n]*(?:(?:Dr|Dra|Prof|Ing|Dipl)\b\.?[^\S\n]+|{_PARTICLE})*"

PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")),
    ("card", re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")),
    ("phone", PHONE),
    ("secret", re.compile(r"(?i)(?<=[\"'=: ])(?=[a-f]*\d)[0-9a-f]{32,64}(?![0-9a-z])")),
    ("name", re.compile(rf"\b(?P<title>{_TITLE})\b\.?{_BEFORE}(?P<first>{_WORD})(?:[^\S\n]+(?P<second>{_PARTICLE}?{_WORD}))?")),
]

ENTITY = "start: int, end: int, kind: string, gender: string, plain: string"


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, gender, canonical form) of all entities, without overlaps; earlier patterns win."""
    out: list[tuple[int, int, str, str, str]] = []

    def free(a: int, b: int) -> bool:
        # Of the spans of earlier patterns, which do not overlap, the last that starts before b.
        n = bisect_left(starts, b)
        return n == 0 or ends[n - 1] <= a

    for kind, pattern in PATTERNS:
        known = sorted(x[:2] for x in out)
        starts, ends = [x[0] for x in known], [x[1] for x in known]
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            raw, gender = m[0], ""
            if kind == "email":
                plain = raw.lower()
            elif kind == "ip":
                if any(int(x) > 255 for x in raw.split(".")):
                    continue
                plain = ".".join(str(int(x)) for x in raw.split("."))
            elif kind == "card":
                plain = re.sub(r"\D", "", raw)
                if luhn_sum(plain) % 10:
                    continue
                # Behind a plus or 00 a run may pass by chance.
                sign = a - (text[a - 1 : a] == "+")
                if (sign < a or plain.startswith("00")) and PHONE.match(text, sign):
                    continue
            elif kind == "phone":
                # The same number behind 00, behind a plus, and with a bracketed zero is one entity.
                zeros = len(m["zeros"] or "")
                a += zeros
                sign = "+" if zeros or raw[0] == "+" else ""
                plain = sign + re.sub(r"\D", "", raw[zeros:].replace("(0)", ""))
            elif kind == "secret":
                plain = raw.lower()
            else:
                first, second = m["first"], m["second"] or ""
                if not first[:1].isupper():
                    continue
                bare = re.sub(r"(?<=.)['’]s$", "", first)
                a = m.start("first")
                b = a + len(bare)
                if bare == first and re.split(r"\s+|^d['’]", second)[-1][:1].isupper():
                    b = m.start("second") + len(re.sub(r"(?<=.)['’]s$", "", second))
                gender, plain = TITLES[m["title"]], unicodedata.normalize("NFC", text[a:b]).lower()
                plain = re.sub(r"\s+", " ", re.sub("[\u2010\u2011]", "-", re.sub("[’ʼ]", "'", plain)))
            if free(a, b):
                out.append((a, b, kind, gender, plain))
    return sorted(out)


class Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, plain: str, attempt: int):
        self.key, self.name, self.n, self.rest = key, f"{kind}\0{plain}\0{attempt}", 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 4:
            self.rest += hmac.new(self.key, f"{self.name}\0{self.n}".encode(), hashlib.sha256).digest()
            self.n += 1
        value, self.rest = int.from_bytes(self.rest[:4], "big"), self.rest[4:]
        return value % n


#: Alphabets by script: a letter is replaced within its own. Fixed values.
ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
]
#: Syllables for names, and the endings that tell gender, by script. Fixed values.
SYLLABLES = {
    "latin": (["ba", "do", "ke", "li", "mar", "no", "ra", "sel", "ti", "vo", "wen", "zo"], {"m": "on", "f": "ina"}),
    "cyrillic": (["ба", "до", "ке", "ли", "мар", "но", "ра", "сел", "ти", "во"], {"m": "ов", "f": "ова"}),
    "greek": (["βα", "δο", "κε", "λι", "μαρ", "νο", "ρα", "σελ", "τι"], {"m": "ος", "f": "ινα"}),
}


def like(char: str, s: Stream) -> str:
    if char.isdigit() and char.isascii():
        return str(s.below(10))
    for letters in ALPHABETS:
        if char in letters:
            return letters[s.below(len(letters))]
    if char.isalpha():  # another script: a neighbour in its block of 16
        other = chr((ord(char) & ~15) | s.below(16))
        return other if other.isalpha() and other.lower() == other else char
    return char


def surrogate(key: bytes, kind: str, gender: str, plain: str, attempt: int) -> str:
    """The canonical surrogate. Later attempts of short e-mail names and names are longer, so one is always free."""
    digits = plain.lstrip("+")
    s = Stream(key, f"{kind}{gender}", digits if kind == "phone" else plain, attempt)
    if kind == "email":
        head, _, last = plain.rpartition(".")
        user, at, host = head.partition("@")
        more = "".join("abcdefghijklmnopqrstuvwxyz"[s.below(26)] for _ in range(attempt // 4))
        return "".join(like(c, s) for c in user) + more + at + "".join(like(c, s) for c in host) + "." + last
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        body = plain[0] + "".join(str(s.below(10)) for _ in plain[1:-1])
        return body + str((10 - luhn_sum(body + "0") % 10) % 10)
    if kind == "phone":
        # The calling code or the zero before an area code stays, and what tells the form of a national number.
        code = CODE.match(digits) if plain != digits else re.match("0*", digits)
        keep = len(code[0]) if code else 0
        national = len(digits) if plain == digits and not keep else 0
        keep += national == 9
        out = digits[:keep]
        for i in range(keep, len(digits)):
            least = 2 if national == 10 and i in (0, 3) else int(i == keep)
            out += str(least + s.below(10 - least))
        return plain[: len(plain) - len(digits)] + out
    if kind == "secret":
        return "".join("0123456789abcdef"[s.below(16)] for _ in plain)
    script = "latin"
    if any("Ѐ" <= c <= "ӿ" for c in plain):
        script = "cyrillic"
    elif any("Ͱ" <= c <= "Ͽ" for c in plain):
        script = "greek"
    syllables, endings = SYLLABLES[script]
    words = re.split("([ '-])", plain)
    for i in range(0, len(words), 2):
        if i and (words[i] in PARTICLES or words[i] == "d" and words[i + 1 : i + 2] == ["'"]):
            continue
        n = 2 + attempt // 2 + (i == 0 and attempt % 2)
        words[i] = "".join(syllables[s.below(len(syllables))] for _ in range(n))
    words[0] += endings[gender]
    return "".join(words)


def written(kind: str, raw: str, plain: str) -> str:
    """The canonical surrogate in the format of a mention."""
    if kind in ("card", "phone"):
        digits, out = iter(plain.lstrip("+")), []
        for c in re.findall(r"\(0\)|.", raw, re.S):
            out.append(next(digits, "") if c.isdigit() else c)
        return "".join(out) + "".join(digits)
    if kind == "ip":
        return plain
    if kind == "name":
        new, out = iter(re.split("[ '-]", plain)), []
        for i, c in enumerate(re.split(rf"(\s+|{_JOINT})", raw)):
            w = c if i % 2 else next(new, "")
            out.append(w.upper() if raw.isupper() else w[:1].upper() + w[1:] if c[:1].isupper() else w)
        return "".join(out)
    if raw.isupper():
        return plain.upper()
    if len(raw) == len(plain):
        return "".join(p.upper() if r.isupper() else p for r, p in zip(raw, plain, strict=True))
    return plain


def _detect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()),
                               ("gender", pa.string()), ("plain", pa.string())]))
    names = ("start", "end", "kind", "gender", "plain")
    for part in parts:
        found = [[dict(zip(names, x, strict=True)) for x in find(t)] for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["key", "entities"])


def _assign(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
            made = [surrogate(key, *row) for row in rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, "made"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``gender``, ``plain`` (distinct, stored) with ``made``: distinct per kind, and no real entity."""
    schema = "kind string, gender string, plain string, attempt int, made string"
    real = entities.select("kind", F.col("plain").alias("made")).distinct()
    taken: list[DataFrame] = []
    todo, left = entities.withColumn("attempt", F.lit(0)), 1
    while left:
        tried = materialize(todo.mapInArrow(_assign(key), schema), "tried-surrogates")
        # Those from earlier rounds keep theirs; among the new ones the smallest entity does.
        rank = F.struct("kind", "plain", "gender")
        first = tried.groupBy("kind", "made").agg(F.min(rank).alias("_first"))
        free = first.join(real, ["kind", "made"], "left_anti")
        for done in taken:  # few rounds: each leaves only those that met another by chance
            free = free.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        kept = free.select("kind", "made", F.col("_first.plain").alias("plain"), F.col("_first.gender").alias("gender"))
        kept = materialize(kept.select("kind", "gender", "plain", "made"), "kept-surrogates")
        again = tried.join(kept, ["kind", "gender", "plain"], "left_anti")
        todo, left = materialize_counted(
            again.select("kind", "gender", "plain", (F.col("attempt") + 1).alias("attempt")), "again"
        )
        taken.append(kept)
        if len(taken) > 40:
            raise RuntimeError("no free surrogates left for some entities")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for x in sorted(spans, key=lambda x: x["start"]):
        out += [text[at : x["start"]], written(x["kind"], text[x["start"] : x["end"]], x["made"])]
        at = x["end"]
    return "".join(out) + text[at:]


def _replace(columns: list[str]):
    """For ``mapInArrow``: new ``text`` from the last column's spans, whose number replaces them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = columns.index("text")
        for part in parts:
            texts, spans = part.column(where).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            new = [replaced(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            arrays = [*part.columns[:-1], pa.array([len(s or []) for s in spans], pa.int64())]
            arrays[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

    return run


def pseudonymize(docs: DataFrame, key: bytes, counter: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all other columns as they were, and ``counter``: the number
    of replaced mentions (a column of that name is overwritten).

    Null and empty texts stay as they are. Repeated rows and rows without ``doc_id`` are treated each by their text.
    Empty table: no rows. Equal texts get equal results.
    """
    looked = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    key_column = fresh(docs.columns, "_key")
    others = [c for c in docs.columns if c != counter]
    # Equal texts share everything, so the 128-bit hash of the text is the key.
    text_key = F.md5(F.encode(F.col("text"), "UTF-8"))
    found = docs.where(looked).select(text_key.alias("key"), "text").mapInArrow(
        _detect, f"key string, entities array<struct<{ENTITY}>>"
    )
    found = materialize(found.where(F.size("entities") > 0).dropDuplicates(["key"]), "found-entities")
    mentions = found.select("key", F.inline("entities"))
    entities = materialize(mentions.select("kind", "gender", "plain").distinct(), "entities")
    made = materialize(assign(entities, key), "surrogates")
    spans = mentions.join(made, ["kind", "gender", "plain"]).groupBy("key").agg(
        F.collect_list(F.struct("start", "end", "kind", "made")).alias("_spans")
    )
    span_column = fresh([*docs.columns, key_column], "_spans")
    spans = materialize(spans, "spans").select(F.col("key").alias(key_column), F.col("_spans").alias(span_column))
    hit = docs.where(looked).withColumn(key_column, text_key).join(spans.hint("shuffle_hash"), key_column, "left")
    plain = docs.where(~looked).select(*[F.col(f"`{c}`") for c in others], F.lit(0).cast("long").alias(counter))
    hit = hit.select(*[F.col(f"`{c}`") for c in others], F.col(span_column).alias(counter))
    # Plain names for the call, which does not take any name.
    names, numbers = [*others, counter], [f"c{n}" for n in range(len(others) + 1)]
    schema = plain.toDF(*numbers).schema
    return hit.toDF(*numbers).mapInArrow(_replace(others), schema).toDF(*names).unionByName(plain)
