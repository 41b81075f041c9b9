"""Fill-in-the-middle: texts cut at two token boundaries and set in another order, by masks of bits.

A text's UTF-8 bytes become two integers with one bit a byte (`bytes.translate` names the class of each byte): letters
and first bytes of characters. Shifts and boolean operations mark where tokens begin, `bit_count` counts them, and the
place of the r-th is found by halving the mask and counting the lower half. Everything is linear in the text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are rearranged, and of these the share whose suffix comes first.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1
#: Bytes of output in one Arrow batch.
FLUSH = 8 << 20
_LETTER = bytes(48 + (65 <= b <= 90 or 97 <= b <= 122) for b in range(256))
_LEAD = bytes(48 + (not 0x80 <= b < 0xC0) for b in range(256))


def masks(data: bytes) -> tuple[int, int]:
    """Bits, the first byte's lowest, of the bytes where tokens begin and of those where characters begin.

    A token is a stretch of the letters A-Z and a-z or one other character.
    """
    if not data:
        return 0, 0
    back = data[::-1]
    letters, leads = int(back.translate(_LETTER), 2), int(back.translate(_LEAD), 2)
    return leads & ~(letters & (letters << 1)), leads


def place(mask: int, rank: int) -> int:
    """The position of the set bit with `rank` set bits below it."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(data: bytes, drawn: tuple[int, ...], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[bytes, ...] = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, characters of prefix and middle (None if plain), and the output."""
    begins, leads = masks(data)
    n = begins.bit_count()
    if not data or any(m in data for m in marks) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted(place(begins, r) if r < n else len(data) for r in (drawn[0] % (n + 1), drawn[1] % (n + 1)))
    before, upto = ((leads & ((1 << x) - 1)).bit_count() for x in (a, b))
    p, s, m = marks
    first = s + data[b:] + p + data[:a] if drawn[3] % 100 < suffix_first else p + data[:a] + s + data[b:]
    return n, "spm" if drawn[3] % 100 < suffix_first else "psm", before, upto - before, first + m + data[a:b]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n tokens, form (plain, psm, spm), characters of prefix and middle, and the output text.

    A row for each row of docs; where the text is cut follows from `seed` and doc_id alone, so rows with one doc_id are
    drawn alike, and a null doc_id is drawn as an empty one. A null or empty text, and one that holds a marker, stays as
    it is (plain, its lengths null). Other columns of docs are not read. A text of any length takes a few times its size.
    """

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((doc, *rearranged(value.as_py() or b"", draws(doc, seed), rate, suffix_first)))
                size += len(rows[-1][-1])
                if size > FLUSH:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made the output of: markers part it, as no rearranged text holds one."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))).when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """`fill_in_middle`'s rows with hashes in place of texts: of the output, and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
