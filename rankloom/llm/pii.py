"""Surrogates for personal data: keyed replacements of the same kind, format and script.

Emails, phone numbers, IPv4 addresses, card numbers, social security numbers, IBANs, secrets and named
persons are found by pattern. A surrogate is drawn from HMAC-SHA256 of the entity under the caller's
key, so equal entities get equal surrogates in every document without any exchange of state. Digits become
digits, letters letters of the same script and case, separators stay; card numbers keep their check
digit valid or invalid, persons get a given name of the same gender and script.

Distinctness is checked over the whole corpus: where two entities draw one surrogate, or a
surrogate is itself an entity of the corpus, all but the first draw again, until none collide.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import free_name, stored, text_of

MAX_DRAWS = 40

#: Given names by script and gender, and syllables of family names; fixed values, in no special order.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Ida Ines Julia Laura Lena Lucia Maria Marta Nina Olivia Paula Rosa Sara Sofia Vera".split(),
    ("latin", "m"): "Adam Anton Carl Daniel David Emil Felix Hugo Ivan Jan Leo Lucas Marco Martin Oscar Otto Paul Peter Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Кирилл Максим Олег Павел Роман Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Στέφανος".split(),
}
SYLLABLES = {
    "latin": "ba bel bor dan del fen gal hol kar lin mar mel nor ran ros sen tal tor van wil".split(),
    "cyrillic": "ба бел бор вал дан кар лин мар мел нор ран рос сен тал тор".split(),
    "greek": "βα γα δελ καλ λιν μαρ μελ νικ παλ ραν σεν ταλ τορ".split(),
}
FAMILY_END = {("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ης", ("greek", "f"): "η"}
#: Titles before a name, by gender.
TITLES = {
    "m": "Mr Herr Señor Sr Monsieur Господин г-н Κύριος κ".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Госпожа г-жа Κυρία κα".split(),
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ][a-zß-öø-ÿα-ωά-ώа-яё'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

KINDS = [  # the first that matches at a place decides
    ("email", r"(?<![\w.+-])[\w.+-]+@\w[\w-]*(?:\.\w[\w-]*)+"),
    ("secret", r"\bAKIA[A-Z0-9]{16}\b|(?<![\w])[0-9a-fA-F]{32,128}(?![\w])|"
               r"(?<=token = \")[^\"\s]{8,}|(?<=secret = \")[^\"\s]{8,}|(?<=password = \")[^\"\s]{8,}|(?<=api_key = \")[^\"\s]{8,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
              r"|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    ("person", rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, _TITLE), key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,2}}"),
]
_KINDS = [k for k, _ in KINDS]
_FIND = re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', f'(?P=gap)').replace('([ -]?)', '(?P<gap>[ -]?)')})" for k, p in KINDS))
#: No entity without one of these: texts that have none are not searched. Secrets may be of letters only.
_HINT = re.compile(r"[@\d]|AKIA|[a-fA-F]{32}|(?:token|secret|password|api_key) = \"|" + "|".join(map(re.escape, _TITLE)))


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity of a whole text, in order, not overlapping."""
    if not _HINT.search(text):
        return []
    return [(m.start(), m.end(), _kind(m), normal(_kind(m), m.group())) for m in _FIND.finditer(text)]


def _kind(m: re.Match) -> str:
    return "card" if m.lastgroup == "gap" else m.lastgroup


def normal(kind: str, value: str) -> str:
    """What makes two mentions one entity: case of an email, separators of a number do not count."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"[^\d+]", "", value)
    return re.sub(r"\s+", "", value) if kind == "iban" else value


class _Draw:
    """An endless keyed stream of numbers for one entity and draw."""

    def __init__(self, key: bytes, kind: str, norm: str, draw: int):
        self.seed = hmac.new(key, f"{kind}\0{draw}\0{norm}".encode("utf-8", "replace"), hashlib.sha256).digest()
        self.left, self.turn = b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest()
            self.turn += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def script(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _like(norm: str, draw: _Draw, digits: str = "0123456789") -> str:
    """Every letter and digit replaced within its class."""
    out = []
    for c in norm:
        if c.isdigit():
            out.append(digits[draw.below(len(digits))])
        elif c.isalpha():
            letters = LETTERS[script(c)]
            x = letters[draw.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(kind: str, norm: str, key: bytes, draw: int = 0) -> str:
    """The normal form of the replacement."""
    d = _Draw(key, kind, norm, draw)
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, end = domain.rpartition(".")
        return f"{_like(local, d)}@{_like(host, d)}.{end}"
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "card":
        own = norm[0] + "".join(str(d.below(10)) for _ in norm[1:-1])
        right = next(c for c in "0123456789" if luhn(own + c) == 0)
        return own + (right if luhn(norm) == 0 else str((int(right) + 1 + d.below(9)) % 10))
    if kind == "phone":
        head = len(norm) - 10 if norm.startswith("+") and len(norm) > 11 else 1 if norm.startswith("+") else 0
        return norm[:head] + _like(norm[head:], d)
    if kind == "secret" and re.fullmatch(r"[0-9a-fA-F]+", norm):
        hexes = "0123456789ABCDEF" if norm.upper() == norm else "0123456789abcdef"
        return "".join(hexes[d.below(16)] for _ in norm)
    if kind == "iban":
        return norm[:2] + _like(norm[2:], d)
    if kind == "person":
        title, _, name = norm.partition(" ")
        kinds = (script(name), _TITLE[title.rstrip(".")])
        parts = name.split(" ")
        own = [GIVEN[kinds][d.below(len(GIVEN[kinds]))] for _ in parts[:-1]]
        syllables = SYLLABLES[kinds[0]]
        family = "".join(syllables[d.below(len(syllables))] for _ in range(3 + draw // 4)) + FAMILY_END.get(kinds, "")
        return " ".join([title, *own, family.capitalize()])
    return _like(norm, d)


def dressed(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the format of the mention: its separators and, in an email, its capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(replacement)
        return "".join(next(left) if c.isalnum() or c == "+" else c for c in mention)
    if kind == "email" and len(mention) == len(replacement):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, replacement))
    return replacement


def replaced(text: str, key: bytes, draws: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of each, by its new place."""
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, norm in entities(text):
        new = dressed(kind, text[start:end], surrogate(kind, norm, key, draws.get((kind, norm), 0)))
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind, new))
        length += len(new)
        at = end
    return "".join(out) + text[at:] if out else text, spans


def mentions(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, norm): the different entities of each row."""
    id_type = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, norms = [], [], []
            for k, t in enumerate(batch.column(1)):
                for kind, norm in dict.fromkeys((x[2], x[3]) for x in entities(t.as_py())):
                    at.append(k)
                    kinds.append(kind)
                    norms.append(norm)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(kinds, pa.string()), pa.array(norms, pa.string())],
                names=["doc_id", "kind", "norm"],
            )

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType())])
    return docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t")).mapInArrow(run, schema)


def _drawn(entity: DataFrame, key: bytes) -> DataFrame:
    """Add ``new``, the surrogate of (kind, norm, draw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, n, key, d) for k, n, d in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "norm", "draw", "new"])

    return entity.select("kind", "norm", "draw").mapInArrow(run, "kind string, norm string, draw int, new string")


def draws(entity: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, draw) of the entities whose first surrogate is taken: by another one or by a real entity.

    ``entity``: distinct (kind, norm). Of the entities that draw one surrogate the one with the
    fewest draws, then the smallest, keeps it. Fails if MAX_DRAWS do not make all distinct.
    """
    now = stored(_drawn(entity.withColumn("draw", F.lit(0)), key), "surrogates")
    for _ in range(MAX_DRAWS):
        first = now.groupBy("kind", "new").agg(F.min(F.struct("draw", "norm")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.filter("n > 1").select("kind", "new", "first")
        lost = now.join(shared, ["kind", "new"]).filter(F.struct("draw", "norm") != F.col("first")).select("kind", "norm")
        real = entity.select("kind", F.col("norm").alias("new"))
        taken = stored(lost.union(now.join(real, ["kind", "new"], "left_semi").select("kind", "norm")).distinct(), "taken")
        if taken.isEmpty():
            return now.filter("draw > 0").select("kind", "norm", "draw")
        again = _drawn(now.join(taken, ["kind", "norm"]).withColumn("draw", F.col("draw") + 1), key)
        now = stored(now.join(taken, ["kind", "norm"], "left_anti").union(again), "surrogates")
    raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")


def pseudonymise(docs: DataFrame, key: str, *, id: str = "doc_id", text: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` with its texts' entities replaced; no other column changes.

    ``spans`` names a column to add: array of (start, end, kind, surrogate) by place in the new text.
    Null and empty texts stay as they are. Rows that repeat an id are handled one by one. The few
    entities that had to draw again reach their documents as a join by id, whose small side Spark
    broadcasts if it is small. No rows give no rows.
    """
    secret = key.encode()
    found = stored(mentions(docs, id=id, text=text), "mentions")
    again = stored(draws(found.select("kind", "norm").distinct(), secret), "draws")
    own = free_name(docs.columns, "_draws")
    if again.isEmpty():
        wide = docs.withColumn(own, F.lit(None).cast("array<struct<kind:string,norm:string,draw:int>>"))
    else:
        exceptions = stored(
            found.join(again, ["kind", "norm"]).groupBy("doc_id")
            .agg(F.collect_set(F.struct("kind", "norm", "draw")).alias(own)).withColumnRenamed("doc_id", own + "_id"),
            "draws-by-document",
        )
        wide = docs.join(exceptions, docs[id].eqNullSafe(exceptions[own + "_id"]), "left").drop(own + "_id")
    span_type = T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()),
        T.StructField("surrogate", T.StringType()),
    ]))
    schema = T.StructType(list(docs.schema) + ([T.StructField(spans, span_type)] if spans else []))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = [], []
            for t, d in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                if t.is_valid:
                    exceptions = {(x["kind"], x["norm"]): x["draw"] for x in d.as_py() or ()}
                    new, own_spans = replaced(t.as_py(), secret, exceptions)
                else:
                    new, own_spans = None, []
                texts.append(new)
                marks.append([dict(zip(("start", "end", "kind", "surrogate"), s)) for s in own_spans])
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            names = batch.schema.names[:-1]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
                columns.append(pa.array(marks, kind))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wide.mapInArrow(run, schema)
