"""Problem 4: one form for texts that look the same but are stored with different characters.

Confusables skeleton: decompose (compatibility form, so width and presentation variants, ligatures
and kinds of blanks become plain characters and joined accents separate ones), drop what is
invisible, replace every letter of another script by the Latin letter it is drawn like, decompose
again. Originals are grouped by equal skeleton. Texts are read and folded once: 128 bits of the skeleton
and the id of the text are written, and everything after works on these.

What still counts: case, accents, line breaks, tabs and the number of blanks.

Defined cases: a null text has a null form and is in no pair; an empty or blank text has itself as
form, but is no case; equal texts are no pair of each other, though each pairs with a text of the
same form; repeated rows are told apart by the key, and a row without one is in no pair; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import expand_pairs, pairs_within, with_text_id
from millrace.session import cut

#: Letters drawn like Latin ones, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԌԚԜӀѴаеѕіјорсухүһԁԍԛԝӏѵ", "ABESIJKMHOPCTYXYhGQWIVaesijopcyxyhdgqwlv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαγινορυϲϳ", "ABEZHIKMNOPTYXCJayivopucj"))
ARMENIAN = dict(zip("ՍՏՕԼհոսօցզյ", "USOLhnuogqj"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVSLCPKB"))
COPTIC = dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
DESERET = dict(zip("𐐄𐐕𐐛𐐠𐐬𐐽𐑈", "OCLSocs"))
OLD_ITALIC = dict(zip("𐌀𐌁𐌂𐌄𐌉𐌑𐌕𐌗𐌠𐌢", "ABCEIMTXIX"))

_KEPT_CONTROLS = {"\t", "\n", "\v", "\f", "\r", "\x85"}
_ASCII_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


@cache
def table() -> dict[int, str | None]:
    """Translation for decomposed text: None for invisible characters, a blank for every blank."""
    out: dict[int, str | None] = {}
    for i in [*range(0x33480), *range(0xE0000, 0xE1000)]:  # the planes that have characters, but for private ones
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cf" or kind == "Cc" and c not in _KEPT_CONTROLS:
            out[i] = None
        elif kind == "Zs" and c != " ":
            out[i] = " "
    for a, b in ((0x34F, 0x34F), (0x115F, 0x1160), (0x180B, 0x180F), (0x17B4, 0x17B5), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)):
        out.update(dict.fromkeys(range(a, b + 1)))  # fillers, joiners and variation selectors
    for script in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, DESERET, OLD_ITALIC):
        out.update({ord(a): b for a, b in script.items()})
    return out


def skeleton(text: str) -> str:
    """The form that is equal for texts a reader cannot tell apart."""
    if text.isascii():
        return _ASCII_CONTROLS.sub("", text)
    out, prototypes = unicodedata.normalize("NFKD", text), table()
    for c in set(out):  # no prototype is itself replaced, so one character after the other may be
        if (n := ord(c)) in prototypes:
            out = out.replace(c, prototypes[n] or "")
    return unicodedata.normalize("NFKD", out)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [None if t is None else skeleton(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string())], names=["key", "form"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        form, keep = [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            s = skeleton(t)
            if s and not s.isspace():
                keep.append(i)
                form.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
        two = np.frombuffer(b"".join(form), np.int64).reshape(-1, 2)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("key").take(at), two[:, 0].copy(), two[:, 1].copy(), b.column("tid").take(at)], names=["key", "f0", "f1", "tid"])


def consistent_form(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, form) for every row."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_forms, "key long, form string").withColumnRenamed("key", key)


def lookalike_pairs(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(id_a, id_b): rows whose texts differ but have the same form, id_a < id_b."""
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = cut(with_text_id(rows).select("key", "tid", "text").mapInArrow(_hashed, "key long, f0 long, f1 long, tid long"))
    mixed = rows.groupBy("f0", "f1").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low <> high").select("f0", "f1")
    members = cut(rows.join(mixed.hint("merge"), ["f0", "f1"], "left_semi"))
    # pairs of different texts first, then their rows: copies are never compared with each other
    texts = pairs_within(cut(members.select("f0", "f1", "tid").distinct()), ["f0", "f1"], "tid")
    pairs = expand_pairs(texts, members.select("tid", F.col("key").alias("id")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
