"""Keyed surrogates for personal data: same type, script, gender and format, always distinct."""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.session import cut_lineage

#: Rounds of drawing again before a draw may get longer than its original.
SAME_LENGTH_ROUNDS = 6
MOST_ROUNDS = 40
#: Setting of a session that holds the key of its surrogates.
KEY_SETTING = "spark.gatelake.surrogates.key"

# Titles by gender, given names by script and gender, syllables of surnames by script.
TITLES = {
    "M": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
    "F": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"),
    "N": ("Dr", "Prof"),
}
GIVEN = {
    ("Latin", "M"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("Latin", "F"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Klara Laura Maria Nora Olga Paula".split(),
    ("Latin", "N"): "Alex Andrea Charlie Dana Eden Jamie Kim Luca Morgan Nico Robin Sam Sasha Taylor Toni Val".split(),
    ("Cyrillic", "M"): "Андрей Борис Виктор Глеб Денис Егор Игорь Кирилл".split(),
    ("Cyrillic", "F"): "Анна Белла Вера Галина Дарья Елена Ирина Клара".split(),
    ("Cyrillic", "N"): "Саша Женя Валя Шура Слава Паша Тоня Миша".split(),
    ("Greek", "M"): "Ανδρέας Γιώργος Δημήτρης Κώστας Λάμπρος Μάριος Νίκος Πέτρος".split(),
    ("Greek", "F"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("Greek", "N"): "Άλεξ Αντώνη Ευγένη Κάρμεν Μάξι Νίκη Ρένη Σάσα".split(),
}
SYLLABLES = {
    "Latin": "ba be bo da de do fa fe ga go ha he ka ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta".split(),
    "Cyrillic": "ба бе бо ва ве га го да де до за зе ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та то".split(),
    "Greek": "βα βε γα γο δα δε ζα ζε θα θε κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"Latin": ("son", "er", "ini", "wood"), "Cyrillic": ("ин", "ов", "енко", "ский"), "Greek": ("ίδης", "άκης", "ου", "έας")}

_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
_UPPER = "".join(c for c in map(chr, [*range(0x41, 0x530), *range(0x1F00, 0x2000)]) if c.isupper())
_NAME = rf"(?!(?:{_TITLE})\b)[{_UPPER}][\w'’-]*[^\W\d_]"
#: Words of sentences that follow a name without a stop; they end it.
_NO_NAME = "The|And|But|For|From|With|This|That|He|She|It|They|We|You|Und|Oder|Ein|Eine|Der|Die|Ist|Hat|Mit|Les|Et"
#: White space inside a name; an empty line ends it.
_GAP = r"(?!\s*\n\s*\n)\s+"
#: Initials and particles inside a name; they stay as they are.
_BETWEEN = rf"(?:(?:(?:[{_UPPER}]\.)+|[{_UPPER}]|von|van|zu|zur|de|del|della|di|da|du|den|der|dos|la|le|ter|bin|ibn|al){_GAP})*"
_NAMES = rf"{_BETWEEN}{_NAME}(?:{_GAP}{_BETWEEN}(?!(?:{_NO_NAME}|{_NO_NAME.upper()})\b){_NAME})*"
_PART = re.compile(rf"(?<![\w'’-]){_NAME}")
_CAPITAL_WORD = re.compile(rf"(?<!\w)[{_UPPER}]\w*(?:['’-]\w+)*")
_POSSESSIVE = re.compile(r"['’][sS]$")
#: Kind, a cheap test that every text with a match of the pattern passes, and the pattern; earlier kinds win.
PATTERNS = (
    ("SECRET", re.compile(r"(?i)pass(?:word|wd)|secret|token|api[_-]?key"), re.compile(r"(?i)\b(?:pass(?:word|wd)|secret|token|api[_-]?key)\b\s*[=:]\s*[\"']?([^\s\"']{6,})")),
    ("SECRET", re.compile(r"[0-9a-fA-F]{32}"), re.compile(r"\b([0-9a-fA-F]{32,})\b")),
    ("EMAIL", re.compile(r"@"), re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("IBAN", re.compile(r"\d"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("CARD", re.compile(r"\d"), re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    ("PHONE", re.compile(r"\d"), re.compile(
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
        r"|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    ("SSN", re.compile(r"\d"), re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("IP", re.compile(r"\d"), re.compile(
        r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")),
    ("PERSON", re.compile(_TITLE), re.compile(
        rf"\b((?:{_TITLE})(?:(?:\.\s*|\s+)(?:{_TITLE})\b)*)(?:\.\s*|\s+)({_NAMES})")),
)


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str
    gender: str


def script_of(text: str) -> str:
    """The script of most letters, Latin for none of the three."""
    counts = {
        "Cyrillic": sum("Ѐ" <= c <= "ӿ" for c in text), "Greek": sum("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in text)
    }
    best = max(counts, key=counts.get)
    return best if 2 * counts[best] > sum(c.isalpha() for c in text) else "Latin"


def canonical_form(kind: str, raw: str) -> str:
    """What equal entities have in common, however they are written."""
    if kind in ("PHONE", "CARD", "SSN"):
        return re.sub(r"\D", "", raw)
    if kind == "IBAN":
        return raw.replace(" ", "")
    return raw if kind == "SECRET" else raw.lower()


def _like_a_secret(value: str) -> bool:
    """Whether a value behind a keyword is no plain word: a digit, a sign, capitals inside, or too long for one."""
    word = value.rstrip(".,;:)")
    return not word.isalpha() or len(word) >= 16 or any(c.isupper() for c in word[1:]) and not word.isupper()


def find_mentions(text: str) -> list[Mention]:
    """Mentions without overlaps, in order of their start; a person's name parts are mentions of their own.

    Persons are found behind a title; then every capitalised word of the text
    that equals a name part found so is a mention of it, with or without title.
    A part that is a given name and a surname counts as in its first mention.
    """
    taken: list[Mention] = []
    for kind, needs, pattern in PATTERNS:
        if not needs.search(text):
            continue
        for match in pattern.finditer(text):
            if kind == "PERSON":
                titles = re.findall(rf"\b(?:{_TITLE})\b", match[1])
                gender = next((g for g in "MF" for t in titles if t in TITLES[g]), "N")
                parts = [(m.start(), m.start() + len(_POSSESSIVE.sub("", m[0]))) for m in _PART.finditer(text, *match.span(2))]
                spans = [(*part, "GIVEN") for part in parts[:-1]] + [(*parts[-1], "SURNAME")]
            else:
                gender, group = "N", 1 if kind == "SECRET" else 0
                end = match.end(group)
                if kind == "SECRET" and not _like_a_secret(match[1]) or kind == "CARD" and _luhn(canonical_form(kind, match[0])):
                    continue
                while kind == "EMAIL" and text[end - 1] in ".-":
                    end -= 1
                spans = [(match.start(group), end, kind)]
            for start, end, part in spans:
                taken.append(Mention(start, end, part, canonical_form(part, text[start:end]), gender))
    rank = {"SECRET": 0, "EMAIL": 1, "IBAN": 2, "CARD": 3, "PHONE": 4, "SSN": 5, "IP": 6, "GIVEN": 7, "SURNAME": 7}
    # Kinds are accepted in their order; a mention that touches an accepted one is dropped.
    accepted: list[Mention] = []
    free = bytearray(len(text) + 1)
    for m in sorted(taken, key=lambda m: (rank[m.kind], m.start)):
        if not any(free[m.start : m.end]):
            free[m.start : m.end] = b"\1" * (m.end - m.start)
            accepted.append(m)
    parts = {m.canonical: m for m in reversed(accepted) if m.kind in ("GIVEN", "SURNAME")}
    for start, end in _bare_words(text) if parts else ():
        known = parts.get(canonical_form("SURNAME", text[start:end]))
        if known and not any(free[start:end]):
            free[start:end] = b"\1" * (end - start)
            accepted.append(Mention(start, end, known.kind, known.canonical, known.gender))
    return sorted(accepted, key=lambda m: m.start)


def _bare_words(text: str) -> Iterator[tuple[int, int]]:
    """Spans of capitalised words: whole, without a possessive ending, and the parts of compounds."""
    for match in _CAPITAL_WORD.finditer(text):
        start, word = match.start(), match[0]
        yield match.span()
        if not word.isalnum():
            yield start, start + len(_POSSESSIVE.sub("", word))
            yield from (
                (start + m.start(), start + m.end()) for m in re.finditer(r"\w+", word) if m[0][0].isupper() and m[0] != word
            )


class _Draw:
    """An endless stream of numbers below a bound, from key, entity and round."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.block, self.left = (key, "\x1f".join(map(str, parts)).encode()), 0, b""

    def below(self, bound: int) -> int:
        if len(self.left) < 8:
            self.left = hashlib.blake2b(self.seed[1] + b"\x1f%d" % self.block, key=self.seed[0]).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % bound

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Letters for letters of their script and case, digits for digits (hexadecimal stays so)."""
        is_hex = re.fullmatch(r"(?=.*[a-f])(?=.*\d)[0-9a-f]+", text)
        if hexadecimal and not is_hex:
            is_hex = re.fullmatch(r"(?=.*[a-fA-F])[0-9a-fA-F]{32,}", text)
        out = []
        for c in text:
            if is_hex:
                out.append(("0123456789ABCDEF" if text.isupper() else "0123456789abcdef")[self.below(16)])
            elif c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                new = {"Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшыэюя",
                       "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}[script_of(c)]
                new = new[self.below(len(new))]
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def _mod97(text: str) -> int:
    """Letters as numbers from 10 on, the whole modulo 97."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def draw_surrogate(kind: str, canonical: str, gender: str, key: bytes, turn: int) -> str:
    """The surrogate in canonical form that an entity proposes in a round."""
    draw = _Draw(key, kind, canonical, turn)
    extra = max(0, turn - SAME_LENGTH_ROUNDS)
    if kind == "EMAIL":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        # example.com, .net and .org belong to nobody.
        host = _Draw(key, "DOMAIN", domain)
        under = [host.like(label) for label in labels[:-2]]
        ending = labels[-1] if labels[-1] in ("com", "net", "org") else ("com", "net", "org")[host.below(3)]
        return draw.like(local + "0" * extra) + "@" + ".".join([*under, "example", ending])
    if kind == "IP":
        return f"{240 + draw.below(15)}." + ".".join(str(draw.below(255)) for _ in range(3))  # reserved block
    if kind == "CARD":
        body = canonical[0] + draw.like(canonical[1:-1] + "0" * extra)
        want = _luhn(canonical)
        return body + next(d for d in "0123456789" if _luhn(body + d) == want)
    if kind == "PHONE":
        keep = 1 if canonical[0] == "1" else 2 if len(canonical) > 10 else 0
        return canonical[:keep] + draw.like(canonical[keep:] + "0" * extra)
    if kind == "IBAN":
        body = draw.like(canonical[4:] + "0" * extra)
        # Valid check digits stay valid, wrong ones become others.
        check = f"{98 - _mod97(body + canonical[:2] + '00'):02}" if _mod97(canonical[4:] + canonical[:4]) == 1 else draw.like(canonical[2:4])
        return canonical[:2] + check + body
    if kind in ("GIVEN", "SURNAME"):
        script = script_of(canonical)
        syllable = lambda: SYLLABLES[script][draw.below(32) % len(SYLLABLES[script])]
        if kind == "GIVEN":
            names = GIVEN[script, gender]
            name = names[draw.below(len(names))].lower()
            return name + "".join(syllable() for _ in range(min(turn, 4) + extra))
        ending = ENDINGS[script][draw.below(4)]
        return syllable() + syllable() + syllable() + "".join(syllable() for _ in range(extra)) + ending
    return draw.like(canonical + "0" * extra, kind == "SECRET")


def _written_like(surrogate: str, mention: Mention, raw: str) -> str:
    """The canonical surrogate in the spelling of a mention: its separators and its case."""
    if mention.kind in ("PHONE", "CARD", "SSN", "IBAN"):
        out, rest = [], list(surrogate)
        for c in raw:
            out.append(rest.pop(0) if c.isalnum() and rest else c)
        return "".join(out + rest)
    if mention.kind in ("GIVEN", "SURNAME"):
        return surrogate.upper() if raw.isupper() and len(raw) > 1 else surrogate[:1].upper() + surrogate[1:]
    if mention.kind == "EMAIL":
        return surrogate.upper() if raw.isupper() else surrogate
    return surrogate


def rewrite(text: str, names: dict[tuple[str, str], str]) -> tuple[str, list[dict]]:
    """The text with surrogates, and the replaced spans (in the new text, with kind)."""
    out, spans, last, at = [], [], 0, 0
    for m in find_mentions(text):
        new = _written_like(names[m.kind, m.canonical], m, text[m.start : m.end])
        out += [text[last : m.start], new]
        at += m.start - last
        spans.append({"kind": m.kind, "start": at, "end": at + len(new)})
        at += len(new)
        last = m.end
    return "".join([*out, text[last:]]), spans


def _mention_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (a, b, *entity)
            for a, b, text in zip(batch["h1"], batch["h2"], batch["text"], strict=True)
            for entity in {(m.kind, m.canonical, m.gender) for m in find_mentions(text)}
        ]
        yield pd.DataFrame(rows, columns=["h1", "h2", "kind", "canonical", "gender"])


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, surrogate`` for a table of distinct ``kind, canonical, gender``.

    In each round the open entities propose a surrogate. One that equals a real
    entity of its kind or one given earlier is refused; of several proposers the
    smallest canonical form gets it. The rest draw again, so distinct entities
    keep distinct surrogates. Each round is a written table.
    """

    def propose(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                drawn = [
                    draw_surrogate(kind, canonical, gender, key, turn)
                    for kind, canonical, gender in zip(batch["kind"], batch["canonical"], batch["gender"], strict=True)
                ]
                yield batch.assign(surrogate=drawn)

        return run

    schema = "kind string, canonical string, gender string, surrogate string"
    real = entities.select(F.col("kind").alias("k"), F.col("canonical").alias("s"))
    given, waiting = None, entities
    for turn in range(MOST_ROUNDS):
        proposed = cut_lineage(waiting.mapInPandas(propose(turn), schema), "surrogates")
        taken = real if given is None else real.union(given.select("kind", "surrogate"))
        free = proposed.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_anti")
        won = cut_lineage(
            free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"),
            "surrogates",
        )
        given = won if given is None else given.union(won)
        waiting = cut_lineage(
            proposed.drop("surrogate").join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "surrogates"
        )
        if waiting.isEmpty():
            return given
    raise RuntimeError("no free surrogates are left; the format of some kind has too few values")


def _secret_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or a random one: no key is known to anyone who reads this code."""
    told = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(told.encode()).digest() if told else secrets.token_bytes(32)


def replace_personal_data(documents: DataFrame, text: str, key: bytes | None = None) -> DataFrame:
    """The documents with surrogates in ``text``, plus ``replaced``: array of ``kind, start, end``.

    Every entity (kind and canonical form) has one surrogate in all documents, so
    mentions of one entity stay mentions of one. Surrogates depend on ``key`` and
    the entity only, apart from collisions; without a key the session's setting
    ``KEY_SETTING`` is used, and where that is unset a random one for this call. A given name's gender is that of most
    of its titles. Entities are found again when texts are rewritten, so only the
    pairs of entity and surrogate of each text are joined to it, by two hashes.

    Null texts stay null with an empty list; texts without entities stay as they
    are. Other columns are kept; a column named like ``replaced`` is replaced.
    Repeated rows are rewritten alike.
    """
    names = [c for c in documents.columns if c != "replaced"]
    inner = [f"c{i}" for i in range(len(names))]
    at = inner[names.index(text)]
    rows = documents.select(*names).toDF(*inner).withColumns({"h1": F.xxhash64(at), "h2": F.hash(at)})
    found = cut_lineage(
        rows.where(F.col(at).isNotNull()).select("h1", "h2", F.col(at).alias("text"))
        .mapInPandas(_mention_rows, "h1 long, h2 int, kind string, canonical string, gender string"),
        "surrogates",
    )
    by_gender = found.groupBy("kind", "canonical", "gender").agg(F.count("*").alias("n"))
    known = F.max(F.struct(F.col("gender") != "N", "n", "gender"))["gender"].alias("gender")
    entities = cut_lineage(by_gender.groupBy("kind", "canonical").agg(known), "surrogates")
    given = assign_surrogates(entities, _secret_key(documents.sparkSession) if key is None else key)
    pairs = found.select("h1", "h2", "kind", "canonical").distinct().join(given, ["kind", "canonical"])
    per_text = pairs.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(
        F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("names")
    )
    joined = rows.join(per_text, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [
                rewrite(t, {(n["kind"], n["canonical"]): n["surrogate"] for n in own}) if own is not None else (t, [])
                for t, own in zip(batch[at], batch["names"], strict=True)
            ]
            yield batch[inner].assign(**{at: [d[0] for d in done], "replaced": [d[1] for d in done]})

    kinds = ", ".join(f"{c} {t}" for c, t in joined.select(*inner).dtypes)
    spans = "array<struct<kind:string,start:int,end:int>>"
    out = joined.select(*inner, "names").mapInPandas(run, f"{kinds}, replaced {spans}")
    return out.toDF(*names, "replaced")
