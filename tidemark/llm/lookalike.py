"""One consistent form for texts that look the same but are made of different characters.

The form drops invisible characters, turns every kind of space into the plain one, full-width characters into the usual
ones and letters drawn like Latin letters into those, and composes accents (NFC). What a reader can see stays: case,
accents, digits and their height (no compatibility decomposition), line ends, the number of spaces. All of it is SQL
that DuckDB runs on the Arrow batches inside the tasks.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import col, fresh, lookup_join
from ..sources.shared import written
from .duck import in_duckdb

#: Letters of other alphabets, and of phonetic script, that are drawn like Latin letters.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "τ": "t",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Armenian, phonetic, dotless
    "օ": "o", "ɡ": "g", "ı": "i",
}
#: Characters without any width or mark of their own.
INVISIBLE = "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e007f]"
#: The kinds of space.
SPACES = "[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
#: Characters between which a joiner is part of one picture and stays.
PICTURE = "[\u2600-\u27bf\ufe0f\U0001f000-\U0001faff]"
#: Fixed value: a full-width sign whose form is no single usual character in the standard.
WIDE_SIGNS = {"￣": "¯"}
#: The blocks whose compatibility forms look like the usual letters: Roman numerals, width forms, mathematical
#: letters.
COMPATIBLE = ((0x2160, 0x2180), (0xFF01, 0xFFEF), (0x1D400, 0x1D7CE))
JOINER, KEPT = "\u200d", "\ue2d0"  # the second stands for the first while invisible characters are dropped


def _composed(letters: dict[str, str]) -> dict[str, str]:
    """``letters`` and every accented letter built on one of them."""
    out = dict(letters)
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in letters:
            out[c] = unicodedata.normalize("NFC", letters[d[0]] + d[1:])
    return out


def _compatible() -> dict[str, str]:
    """Width forms, Roman numerals and mathematical letters, by the standard's own decompositions. Digits drawn at
    another height aren't in these blocks; mathematical digits and signs stay."""
    out = {}
    for lo, hi in COMPATIBLE:
        for c in map(chr, range(lo, hi)):
            form = unicodedata.normalize("NFKC", c)
            if form != c and unicodedata.decomposition(c) and (lo != 0x1D400 or form.isalpha()) and not set(form) & set(" \u1160\u115f"):
                out[c] = form
    return out | WIDE_SIGNS


def table() -> dict[str, str]:
    """Character to character or short string: look-alikes, with their accented letters, and compatibility forms, which may
    be of look-alikes themselves."""
    letters = _composed(LOOKALIKES)
    return letters | {k: "".join(letters.get(c, c) for c in v) for k, v in _compatible().items()}


def caseless_table() -> dict[str, str]:
    """As ``table``, to lower case, and closed under case: a letter whose capital is a look-alike follows its capital, since
    texts that are compared without regard to case may be written in capitals on either side."""
    letters = {k: v.lower() for k, v in LOOKALIKES.items()}
    letters |= {k.lower(): v.lower() for k, v in LOOKALIKES.items() if k.isupper() and k.lower() not in letters}
    letters = _composed(letters)
    return letters | {k: "".join(letters.get(c, c).lower() for c in v) for k, v in _compatible().items()}


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(c: str, letters: dict[str, str] | None = None) -> str:
    """The form of a text as a DuckDB expression. Null stays null, an empty text empty."""
    letters = table() if letters is None else letters
    one = {k: v for k, v in letters.items() if len(v) == 1}
    joined = f"({PICTURE}){JOINER}({PICTURE})"
    x = c
    for _ in range(2):  # neighbours share a character
        x = f"regexp_replace({x}, {text_literal(joined)}, {text_literal(r'\1' + KEPT + r'\2')}, 'g')"
    x = f"regexp_replace({x}, {text_literal(INVISIBLE)}, '', 'g')"
    x = f"nfc_normalize(regexp_replace({x}, {text_literal(SPACES)}, ' ', 'g'))"
    several = {k: v for k, v in letters.items() if len(v) > 1}
    if several:  # rare, so a text is looked through for all of them first
        y = "v"
        for k, v in several.items():
            y = f"replace({y}, {text_literal(k)}, {text_literal(v)})"
        x = f"list_transform([{x}], lambda v: CASE WHEN regexp_matches(v, {text_literal('[' + ''.join(several) + ']')}) THEN {y} ELSE v END)[1]"
    x = f"translate({x}, {text_literal(''.join(one) + KEPT)}, {text_literal(''.join(one.values()) + JOINER)})"
    return f"nfc_normalize({x})"


def consistent_text(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with the column ``out``, the form of ``text``; all else passes through. Null and empty texts stay so."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already")
    quoted = '"' + text.replace('"', '""') + '"'
    schema = df.withColumn(out, F.lit(None).cast("string")).schema
    return in_duckdb(df, f'SELECT *, {form_sql(quoted)} AS "{out}" FROM batch', schema)


def _keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, raw, form): digests of each text that is neither null nor empty, and of its form."""
    used = df.select(col(doc_id).cast("long").alias("id"), col(text).alias("t")).filter(F.length("t") > 0)
    sql = f"SELECT id, unhex(sha256(t)) AS raw, unhex(sha256({form_sql('t')})) AS form FROM batch"
    return in_duckdb(used, sql, "id long, raw binary, form binary")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, writings): for each document with a text the least id of those that look the same, and how many
    different texts they have. One row a document, whatever the size of the class."""
    keys = written(_keys(df, doc_id, text), "forms")
    # Distinct writings are counted over (form, raw), so copies are gone before they meet.
    per = keys.groupBy("form", "raw").agg(F.min("id").alias("least")).groupBy("form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("writings"))
    per = written(per, "form-classes")
    return lookup_join(keys, per, ["form"], F.col("id")).select(F.col("id").alias("doc_id"), "class_id", "writings")


def same_looking_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that look the same and are not equal as stored; null and empty texts never.

    Only forms with several writings are paired, so exact copies alone make no work. The smaller id's side is salted and
    the other repeated, so the pairs of a large class are made by many tasks. Rows with a null id have no pairs.
    """
    keys = written(_keys(df, doc_id, text).filter(F.col("id").isNotNull()), "forms")
    several = written(keys.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("form"), "written-twice")
    members = written(lookup_join(keys, several, ["form"], F.col("id")).distinct(), "members")
    left = members.select(F.col("id").alias("doc_id_a"), F.col("raw").alias("ra"), "form", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    right = members.select(F.col("id").alias("doc_id_b"), F.col("raw").alias("rb"), "form", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = left.join(right, ["form", "salt"]).filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("ra") != F.col("rb")))
    return pairs.select("doc_id_a", "doc_id_b")
