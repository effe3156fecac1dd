"""PII surrogates: keyed, type-consistent replacements.

1. Detect: one regex finds e-mail addresses, IPv4 addresses, IBANs, social
   security numbers, phone numbers, payment card numbers and names of persons
   (after a title, or a known given name before a surname; the whole run of
   capitalised words, the last one the surname) in the whole text.
   Only texts that could hold any are read by Python.
2. Entities: the distinct (kind, canonical form) pairs of the corpus. Letter
   case, separators and titles are no part of the canonical form, phone
   numbers have their country code in it whether written or not, and names
   are taken word by word, so all mentions of an entity share one surrogate.
3. Draw: a keyed BLAKE2b of kind, canonical form and attempt gives a surrogate
   of the same shape: digits for digits, letters of the same script and case,
   name endings of the same gender, the same country code, valid check digits
   where they were valid.
4. Check: a surrogate that equals a real entity of its kind, or that a
   lower-sorting entity drew too, is drawn again, until all are distinct. The
   checks are joins and aggregations over the entity tables.
5. Replace: every mention gets its entity's surrogate in the mention's own
   format (separators, case, country code or none). Country codes are equal,
   so what step 4 checked is what is written.

Entities, surrogates and replacements stay distributed; an entity that a third
of all documents mention is one row of the drawing and a skewed join key that
AQE splits.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table

#: Titles by the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "κυρία"],
    "n": ["Dr", "Prof", "Professor", "Doctor", "Doktor"],
}
#: Given names by gender.
GIVEN = {
    "m": ["Alexander", "Andreas", "Antonio", "Carlos", "Charles", "Christopher", "Daniel", "David", "François",
          "George", "Hans", "Henri", "James", "Jean", "John", "José", "Juan", "Jürgen", "Klaus", "Luis", "Manuel",
          "Matthew", "Michael", "Miguel", "Paul", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan",
          "Thomas", "Thorsten", "William", "Wolfgang", "Александр", "Дмитрий", "Иван", "Сергей"],
    "f": ["Angela", "Anna", "Barbara", "Brigitte", "Carmen", "Catherine", "Christine", "Claire", "Claudia",
          "Dolores", "Elena", "Elisabeth", "Elizabeth", "Emily", "Françoise", "Isabelle", "Jennifer", "Jessica",
          "Julia", "Karen", "Laura", "Linda", "Lucía", "Maria", "María", "Mary", "Monika", "Nathalie", "Patricia",
          "Petra", "Sabine", "Sarah", "Sophie", "Susan", "Teresa", "Ursula", "Анна", "Елена", "Мария", "Ольга"],
}
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
GIVEN_GENDER = {n.lower(): g for g, ns in GIVEN.items() for n in ns}

_UPPER, _LOWER = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]", "[a-zß-öø-ÿа-яёα-ωά-ώ]"
_PART = rf"{_UPPER}{_LOWER}+(?:{_UPPER}{_LOWER}+)*"        # McDonald
_WORD = rf"(?:{_UPPER}['’])?{_PART}(?:[-'’]{_PART})*"
#: Particles before a surname stay as they are. Articles that open a German
#: noun (der, den, das) count only behind another particle.
_PARTICLE = (r"(?:(?:van|von|vom|op|in)(?: (?:de[rnm]?|het|und zu))|van|von|vom|de (?:la|las|los|le)"
             r"|de|del|della|di|da|do|dos|du|ter|bin|ibn)")
_NAME = rf"(?:{_PARTICLE} )?(?:[dl]['’])?{_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
              r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("name", rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(TITLE_GENDER, key=len, reverse=True))})\.? (?P<after>{_NAME}(?: {_NAME})*)"
             rf"|(?P<given>{'|'.join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))}) (?P<sur>{_NAME}(?: {_NAME})*))(?!\w)"),
]
NAME_WORD = re.compile(_WORD)
PII = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS))
def _one_of(words: list[str]) -> str:
    """Regex of a word list, branching letter by letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    arms = [c + (_one_of(rest) if any(rest) else "") for c, rest in sorted(by.items()) if c]
    return f"(?:{'|'.join(arms)}){'?' if '' in by else ''}"


_LISTED = [*TITLE_GENDER, *(n for ns in GIVEN.values() for n in ns)]
#: What every mention contains: texts without any of it are not looked at.
#: Listed words of other scripts are covered by their letters.
HINTS = [r"[0-9][ .()-]*[0-9][ .()-]*[0-9]", r"[\u0370-\u04FF]",
         f"(?=[A-Z]){_one_of([w for w in _LISTED if w.isascii() or w[0].isascii()])}(?![a-z])"]


def hinted(text: Column) -> Column:
    """False only for texts without a mention."""
    out = F.contains(text, F.lit("@"))
    for p in HINTS:
        out = out | F.rlike(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


#: Calling codes of one and two digits; all others have three.
CODES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
#: A trunk zero, not dialled after the country code (in Italy it is).
TRUNK = re.compile(r"\+(?!39)[0-9]{1,3}[ .-]?(\(0\))")


def phone(surface: str) -> str:
    """Canonical phone number: +, country code and national number. The forms
    without a code are North American."""
    trunk = TRUNK.match(surface)
    digits = re.sub(r"[^0-9]", "", surface[:trunk.start(1)] + surface[trunk.end(1):] if trunk else surface)
    return ("+" if surface[0] == "+" else "+1") + digits


SYLLABLES = {
    "latin": ("bcdfghjklmnprstvz", "aeiou"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу"),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιο"),
}
#: Last letters of given names: feminine, masculine.
ENDINGS = {"latin": ("a", "nrs"), "cyrillic": ("а", "нрс"), "greek": ("α", "ς")}
LOOSEN_AFTER = 16      # attempts before a shape that is used up grows by one character


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of all entities, in order. A name gives
    one entry per word; its kind tells gender: ``given:f``, ``surname``."""
    out = []
    for m in PII.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("title", "after", "given", "sur") else "name"
        kind = next(k for k, _ in PATTERNS if m.group(k) is not None)
        if kind != "name":
            s = m.group(kind)
            canon = (s.lower() if kind == "email" else s if kind == "ip" else phone(s) if kind == "phone"
                     else re.sub(r"[^0-9A-Z]", "", s))
            out.append((m.start(), m.end(), kind, canon))
            continue
        words = [(w.start(), w.group()) for w in NAME_WORD.finditer(
            text, m.start("after" if m.group("title") else "given"), m.end())]
        gender = TITLE_GENDER[m.group("title")] if m.group("title") else GIVEN_GENDER[m.group("given").lower()]
        for i, (at, w) in enumerate(words):
            given = len(words) > 1 and i < len(words) - 1
            g = GIVEN_GENDER.get(w.lower(), gender)
            out.append((at, at + len(w), f"given:{g}" if given else "surname", w.lower()))
    return out


class _Draw:
    """Endless keyed choices for one (kind, canonical, attempt)."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int) -> None:
        self.seed = hashlib.blake2b(f"{kind}\0{canon}\0{attempt}".encode(), key=key, digest_size=32).digest()
        self.n, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.seed, self.n.to_bytes(8, "big"), "sha256")
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n

    def of(self, letters: str) -> str:
        return letters[self.below(len(letters))]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _mod97(iban: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _like(d: _Draw, s: str) -> str:
    return "".join(d.of("0123456789") if c.isdigit() else d.of("abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z"
                   else d.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if "A" <= c <= "Z" else c for c in s)


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The surrogate's canonical form."""
    d = _Draw(key, kind, canon, attempt)
    loose = max(0, attempt - LOOSEN_AFTER + 1)
    if kind == "email":
        local, _, host = canon.partition("@")
        name, _, tld = host.rpartition(".")
        return f"{_like(d, local + 'a' * loose)}@{_like(d, name)}.{tld}"
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        parts = [ranges[3 if loose else len(p)] for p in canon.split(".")]
        return ".".join(str(lo + d.below(hi - lo + 1)) for lo, hi in parts)
    if kind == "iban":
        body = _like(d, canon[4:] + "0" * loose)
        check = f"{98 - _mod97(canon[:2] + '00' + body):02d}" if _mod97(canon) == 1 else _like(d, canon[2:4])
        return canon[:2] + check + body
    if kind == "ssn":
        return f"{900 + d.below(100)}{d.below(99) + 1:02d}{d.below(9999) + 1:04d}" + "0" * loose
    if kind == "card":
        body = canon[0] + _like(d, canon[1:-1] + "0" * loose)
        return next(body + c for c in "0123456789" if _luhn(body + c)) if _luhn(canon) else body + d.of("0123456789")
    if kind == "phone":
        code = CODES.match(canon, 1).end()
        return canon[:code] + _like(d, canon[code:] + "0" * loose)
    script = _script(canon)
    consonants, vowels = SYLLABLES[script]
    stem = "".join(d.of(consonants) + d.of(vowels) for _ in range(max(2, len(canon) // 2) + loose + (kind == "surname")))
    feminine, masculine = ENDINGS[script]
    if kind == "given:f":
        return stem[:-1] + feminine
    return stem + d.of(masculine) if kind == "given:m" else stem


def fill(surface: str, kind: str, canon: str) -> str:
    """A surrogate in the format of the mention it replaces."""
    if kind in ("iban", "ssn", "phone", "card"):
        trunk = TRUNK.match(surface) if kind == "phone" else None
        zero = trunk.start(1) + 1 if trunk else -1
        out, at = [], 0 if kind != "phone" else 1 if surface[0] == "+" else 2
        for i, c in enumerate(surface):
            if c.isalnum() and i != zero:
                out.append(canon[at])
                at += 1
            else:
                out.append(c)
        return "".join(out) + canon[at:]
    if kind == "ip":
        return canon
    if kind == "email":
        return "".join(b.upper() if i < len(surface) and surface[i].isupper() else b for i, b in enumerate(canon))
    return canon.upper() if surface.isupper() else canon.capitalize()


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, kinds, canons = [], [], []
        for i, text in enumerate(b.column(2).to_pylist()):
            for kind, canon in sorted({(k, c) for _, _, k, c in mentions(text)}):
                rows.append(i)
                kinds.append(kind)
                canons.append(canon)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(kinds, pa.string()),
                                          pa.array(canons, pa.string())], names=["_ll_id", "_ll_key", "kind", "canon"])


def draw_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon), all
    surrogates of a kind distinct and none a real entity of that kind."""
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    open_, done, attempt = entities, None, 0
    while True:
        now = attempt

        @F.pandas_udf("string")
        def draw(kind, canon):
            return kind.combine(canon, lambda k, c: surrogate(key, k, c, now))
        drawn = kept(open_.withColumn("surrogate", draw("kind", "canon")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = drawn.join(first, ["kind", "surrogate", "canon"], "left_semi").join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done, ["kind", "surrogate"], "left_anti")
        good = kept(good.select("kind", "canon", "surrogate"))
        done = good if done is None else kept(done.unionByName(good))
        open_ = kept(drawn.join(good, ["kind", "canon"], "left_anti").select("kind", "canon"))
        if open_.limit(1).count() == 0:
            return done
        attempt += 1


def replace_mentions(text: str, found: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, canon in mentions(text):
        out += [text[at:start], fill(text[start:end], kind, found[kind, canon])]
        at, n = end, n + 1
    return "".join(out) + text[at:], n


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) with every detected entity replaced in
    ``text_col``, and ``n_entities``, the mentions replaced (in place of a
    column of that name).

    Equal entities get equal surrogates in all rows and in every run with the
    same key. Defined cases: null and empty texts, and texts without an
    entity, are returned as they are with 0; rows without id and repeated rows
    are handled by their text; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    hint = hinted(F.col(text_col))
    key_of = F.xxhash64(F.col(text_col))
    rows = docs.where(hint).select(F.col(id_col).alias("_ll_id"), key_of.alias("_ll_key"), F.col(text_col).alias("_ll_text"))
    kind = rows.schema["_ll_id"].dataType.simpleString()
    found = kept(rows.mapInArrow(_detect, f"_ll_id {kind}, _ll_key long, kind string, canon string").distinct())
    drawn = draw_surrogates(kept(found.select("kind", "canon").distinct()), key)
    per = (found.join(drawn, ["kind", "canon"]).groupBy("_ll_id", "_ll_key")
           .agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("_ll_found"))
           .select(F.col("_ll_id").alias("_ll_of"), F.col("_ll_key").alias("_ll_of_key"), "_ll_found"))

    @F.pandas_udf("text string, n long")
    def rewrite(texts, lists):
        import pandas as pd
        return pd.DataFrame([
            (t, 0) if e is None else replace_mentions(t, {(x["kind"], x["canon"]): x["surrogate"] for x in e})
            for t, e in zip(texts, lists)], columns=["text", "n"])
    joined = docs.where(hint).join(
        per, F.col(id_col).eqNullSafe(F.col("_ll_of")) & (key_of == F.col("_ll_of_key")), "left")
    changed = (joined.withColumn("_ll_new", rewrite(F.col(text_col), F.col("_ll_found")))
               .withColumn(text_col, F.col("_ll_new.text")).select(*columns, F.col("_ll_new.n").alias("n_entities")))
    return changed.unionByName(docs.where(~hint).select("*", F.lit(0).cast("long").alias("n_entities")))


#: Key of the registered query; a real job passes its own secret.
QUERY_KEY = b"op1 registered query"


def op1_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data: doc_id, text,
    n_entities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, QUERY_KEY)
