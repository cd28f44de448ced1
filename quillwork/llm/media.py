"""Media columns: payloads kept without loss in progressive JPEG files, read back as coefficients and as RGB tensors.

A file's unit is the quantised coefficient: byte b is coefficient b - 128, 64 bytes a block, six blocks (four of luma, two
of chroma) a coded unit; blocks past the payload are zeros. Coefficients are coded without loss, so the payload comes back
exactly from the accumulated scans; the inverse transform gives the picture. A payload longer than FRAME is a sequence of
files, one after the other, so that memory is bounded whatever a text's length is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jpeg

UNIT, STEP = 384, 192
#: Bytes of a payload in one file, at most, and bytes that numpy looks at together.
FRAME, SLICE = 2048 * UNIT, 1 << 19
FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    """``raw`` with spaces up to a positive multiple of 192 bytes."""
    return raw.ljust(max(1, -(-len(raw) // STEP)) * STEP)


def written(frames: list[bytes]) -> list[bytes]:
    """A file for each frame; its comment is the frame's number of bytes."""
    shapes = np.array([jpeg.grid(-(-len(f) // UNIT)) for f in frames])
    layout = jpeg.Layout.of(shapes[:, 0], shapes[:, 1])
    blocks = np.zeros((layout.first[-1], 64), np.int16)
    for i, f in enumerate(frames):
        at = int(layout.first[i])
        blocks[at : at + len(f) // 64] = np.frombuffer(f, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    return jpeg.encode(blocks, layout, [b"%d" % len(f) for f in frames])


def read(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The frames and the RGB tensors that files hold."""
    blocks, layout, notes = jpeg.decode(files)
    pixels = jpeg.samples(blocks)
    data = (blocks + 128).astype(np.uint8).reshape(-1)
    at = layout.first[:-1] * 64
    return [data[a : a + int(n)].tobytes() for a, n in zip(at, notes, strict=True)], [jpeg.rgb(pixels, layout, i) for i in range(len(files))]


def _frames(payloads: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    index: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, p in enumerate(payloads):
        for a in range(0, len(p), FRAME):
            f = p[a : a + FRAME]
            if held and size + len(f) > SLICE:
                yield index, held
                index, held, size = [], [], 0
            index.append(i)
            held.append(f)
            size += len(f)
    if held:
        yield index, held


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", want_media: bool = False, want_tensor: bool = False) -> DataFrame:
    """One row per row of ``docs``: identifier and what FEATURES names; all but n_bytes comes from the files, read again.

    With ``want_media`` also media, an array of the files, and with ``want_tensor`` tensors, an array of (height, width, rgb)
    with the pixels' bytes. The feature is the first file's size and the means of red, green and blue over all files, times
    1000. Null and empty texts are one block group of spaces. Rows are stored alone, equal texts alike; other columns aren't
    looked at; no rows give no rows.
    """
    common.tune(docs.sparkSession)
    tensor = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in common.strings(batch.column(1))]
            n = len(raw)
            shas = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            size, media_size, pixels = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            tail, shape, sums = [b""] * n, [""] * n, np.zeros((n, 3), np.int64)
            media: list[list[bytes]] = [[] for _ in range(n)]
            tensors: list[list[dict]] = [[] for _ in range(n)]
            for index, frames in _frames([padded(r) for r in raw]):
                files = written(frames)
                back, images = read(files)
                for i, file, frame, image in zip(index, files, back, images, strict=True):
                    shas[i][0].update(frame)
                    shas[i][1].update(file)
                    size[i] += len(frame)
                    media_size[i] += len(file)
                    tail[i] = frame[-16:]
                    shape[i] = shape[i] or f"{image.shape[1]}x{image.shape[0]}"
                    sums[i] += image.sum(axis=(0, 1), dtype=np.int64)
                    pixels[i] += image.shape[0] * image.shape[1]
                    if want_media:
                        media[i].append(file)
                    if want_tensor:
                        tensors[i].append({"height": image.shape[0], "width": image.shape[1], "rgb": image.tobytes()})
            mean = sums * 1000 // pixels[:, None]
            columns = [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(size), pa.array([a.hexdigest() for a, _ in shas]), pa.array([zlib.crc32(t) for t in tail], pa.int64()),
                       pa.array(media_size), pa.array([b.hexdigest() for _, b in shas]), pa.array([f"{s}:{r}:{g}:{b}" for s, (r, g, b) in zip(shape, mean.tolist(), strict=True)])]
            names = ["id", *(x.split()[0] for x in FEATURES.split(", "))]
            if want_media:
                columns, names = [*columns, pa.array(media, pa.list_(pa.binary()))], [*names, "media"]
            if want_tensor:
                columns, names = [*columns, pa.array(tensors, pa.list_(tensor))], [*names, "tensors"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = f"id {rows.dtypes[0][1]}, {FEATURES}" + ", media array<binary>" * want_media + ", tensors array<struct<height:int,width:int,rgb:binary>>" * want_tensor
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as progressive JPEG and read back. Null texts count as empty, whose payload is 192 spaces; equal texts get
    equal values; an empty table gives no rows."""
    return stored(common.table(spark, sf_dir, "documents"))
