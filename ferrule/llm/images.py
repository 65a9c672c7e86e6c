"""Copies of images, cropped or edited, by local descriptors.

Each image is scanned at several scales for corners (Harris), each corner gets an orientation (the
intensity centroid around it) and 128 binary intensity tests turned by it. The Hamming tables' cells hold a
corner together with one of its nearest corners: 128 bits in four parts, of which two descriptors share
one at least when at most three bits differ; a cell is one part of both corners. Alone, 32 bits
are shared by too many strangers; two corners side by side rarely are.

Candidates are all pairs of images that share HITS cells, found in two rounds so that n copies don't make
n * n pairs: first each image is held against the first image of its cells with which it shares most; then,
cell by cell, all pairs of images that are not in one class by then. Candidates are held against each other by
all their descriptors: matches vote for a similarity transform, CONSENSUS corners in one cell of
scale, turn and shift make a link.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import components, durable, sized, small, table

SCALES, CORNERS, RADIUS, TESTS, HITS, NEAR, CONSENSUS = (1.0, 0.8, 0.64, 0.512), 14, 7, 128, 3, 16, 6
#: Neighbours that a corner is paired with; pixels for which an image has CORNERS corners a scale.
BESIDE, AREA = 2, 128 * 128
TURNS = 32


def _pattern() -> np.ndarray:
    """(TURNS, TESTS, 4): the test points (y, x, y, x) within RADIUS, turned in equal steps."""
    rng = np.random.default_rng(11)
    p = np.clip(rng.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    a = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]).transpose(2, 0, 1)
    return np.rint(np.einsum("tij,nkj->tnki", turn, p)).astype(np.int64).reshape(TURNS, TESTS, 4)


PATTERN = _pattern()


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Grey pixels as a binary portable graymap."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary portable graymap or pixmap of depth 8 (colours are averaged); None for anything else."""
    head, at = [], 0
    data = data or b""
    while len(head) < 4 and at < len(data):
        if data[at : at + 1].isspace():
            at += 1
        elif data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1)
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            head.append(data[at:end])
            at = end
    if len(head) < 4 or head[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in head[1:]) or head[3] != b"255":
        return None
    w, h, n = int(head[1]), int(head[2]), 3 if head[0] == b"P6" else 1
    raw = np.frombuffer(data, np.uint8, offset=min(at + 1, len(data)))
    if not w or not h or len(raw) < w * h * n:
        return None
    return raw[: w * h * n].reshape(h, w, n).mean(axis=2) if n == 3 else raw[: w * h].reshape(h, w).astype(np.float64)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    c = np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) / (k * k)


def resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))
    y, z = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, z = np.clip(y, 0, x.shape[0] - 1), np.clip(z, 0, x.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(x.shape[0] - 2, 0)), np.minimum(z.astype(int), max(x.shape[1] - 2, 0))
    fy, fz = (y - i)[:, None], (z - j)[None, :]
    i1, j1 = np.minimum(i + 1, x.shape[0] - 1), np.minimum(j + 1, x.shape[1] - 1)
    a = x[i][:, j] * (1 - fz) + x[i][:, j1] * fz
    b = x[i1][:, j] * (1 - fz) + x[i1][:, j1] * fz
    return a * (1 - fy) + b * fy


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4: y, x, scale, turn in radians, in the whole image's pixels; n x 2 unsigned longs).

    The strongest corners of each scale: CORNERS for each AREA of the image.
    """
    spots, bits = [], []
    most = CORNERS * max(1, round(pixels.size / AREA))
    for scale in SCALES:
        x = resize(pixels, scale) if scale != 1 else pixels
        r = RADIUS
        if min(x.shape) < 2 * r + 4:
            continue
        gy, gx = np.gradient(_box(x, 1))
        a, b, c = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[r:-r, r:-r]
        top = np.full_like(inner, -np.inf)
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    np.maximum(top, corner[r + dy : corner.shape[0] - r + dy, r + dx : corner.shape[1] - r + dx], out=top)
        y, z = np.nonzero((inner > top) & (inner > 1.0))
        if not len(y):
            continue
        strongest = np.argsort(-inner[y, z], kind="stable")[:most]
        y, z = y[strongest] + r, z[strongest] + r
        d = np.arange(-r, r + 1)
        disc = (d[:, None] ** 2 + d[None, :] ** 2) <= r * r
        patch = x[y[:, None, None] + d[None, :, None], z[:, None, None] + d[None, None, :]] * disc
        turn = np.arctan2((patch * d[None, :, None]).sum((1, 2)), (patch * d[None, None, :]).sum((1, 2)))
        step = np.rint(turn / (2 * np.pi) * TURNS).astype(int) % TURNS
        smooth = _box(x, 1)
        p = PATTERN[step]
        at = lambda i, j: smooth[np.clip(y[:, None] + p[:, :, i], 0, x.shape[0] - 1), np.clip(z[:, None] + p[:, :, j], 0, x.shape[1] - 1)]  # noqa: E731, B023
        bits.append(np.packbits(at(0, 1) < at(2, 3), axis=1).view(np.uint64))
        spots.append(np.stack([(y + 0.5) / scale, (z + 0.5) / scale, np.full(len(y), scale), turn], axis=1))
    if not spots:
        return np.zeros((0, 4)), np.zeros((0, 2), np.uint64)
    return np.concatenate(spots), np.concatenate(bits)


#: A corner's place in one long: quarter pixels of y and x (20 bits each), scale (2), turn (10).
def _pack_spots(spots: np.ndarray) -> np.ndarray:
    y, x = (np.clip(np.rint(spots[:, i] * 4), 0, (1 << 20) - 1).astype(np.int64) for i in (0, 1))
    scale = np.array([SCALES.index(v) for v in spots[:, 2]], np.int64)
    turn = np.rint(spots[:, 3] / (2 * np.pi) * 1024).astype(np.int64) % 1024
    return y << 32 | x << 12 | scale << 10 | turn


def _unpack_spots(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """y, x, log2 of the scale, turn in radians."""
    return (packed >> 32) / 4, (packed >> 12 & 0xFFFFF) / 4, np.log2(SCALES)[packed >> 10 & 3], (packed & 1023) * (2 * np.pi / 1024)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def cells(spots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The image's cells, each once: a hash of one part of a corner's bits and the same part of a near corner's of its scale."""
    part = bits.view(np.uint32).reshape(-1, 4)
    out = [np.zeros((0, 4), np.uint64)]
    for scale in np.unique(spots[:, 2]) if len(spots) else ():
        own = np.flatnonzero(spots[:, 2] == scale)
        k = min(BESIDE, len(own) - 1)
        for lo in range(0, len(own) if k > 0 else 0, 512):
            at = own[lo : lo + 512]
            far = ((spots[at, None, :2] - spots[None, own, :2]) ** 2).sum(axis=2)
            far[np.arange(len(at)), np.arange(lo, lo + len(at))] = np.inf
            a, b = np.repeat(part[at], k, axis=0), part[own[np.argpartition(far, k - 1, axis=1)[:, :k].ravel()]]
            h = np.minimum(a, b).astype(np.uint64) << np.uint64(32) | np.maximum(a, b)
            h = (h ^ (h >> np.uint64(29))) * _MIX[0] + np.arange(4, dtype=np.uint64) * _MIX[1]
            out.append((h ^ (h >> np.uint64(32))) * _MIX[1])
    return np.unique(np.concatenate(out).ravel()).view(np.int64)


def descriptors(images: DataFrame, key: str = "image_id", column: str = "image") -> DataFrame:
    """id, row (unlike any other's), h1, h2 (128 bits of a hash of the bytes), spots (a long a corner), bits (two longs a corner); only what is an image has a row."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in small(batches, 128):
            rows = []
            for key_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key_ is not None and (pixels := decode_pgm(data)) is not None:
                    spots, bits = describe(pixels)
                    h = xxhash.xxh3_128_digest(data)
                    h = [int.from_bytes(h[i : i + 8], "little", signed=True) for i in (0, 8)]
                    row += 1
                    rows.append((key_, row, *h, _pack_spots(spots), bits.view(np.int64).ravel()))
            columns = zip(*rows) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "row", "h1", "h2", "spots", "bits"])

    return images.select(F.col(key).cast("long"), F.col(column)).mapInArrow(run, "id long, row long, h1 long, h2 long, spots array<long>, bits array<long>")


def cell_rows(found: DataFrame) -> DataFrame:
    """id, cell of found(id, spots, bits)."""

    def run(batches):
        for batch in small(batches, 256):
            ids, every = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                y, x, scale, _ = _unpack_spots(batch.column(1)[i].values.to_numpy())
                own = cells(np.stack([y, x, scale], axis=1), batch.column(2)[i].values.to_numpy().reshape(-1, 2))
                ids.append(np.full(len(own), id_))
                every.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, every)], ["id", "cell"])

    return found.select("id", "spots", "bits").mapInArrow(run, "id long, cell long")


def agree(spots_a, bits_a, spots_b, bits_b) -> bool:
    """Geometric consensus: CONSENSUS corners, each other's closest within NEAR bits, vote for one scale, turn and shift."""
    a, b = np.asarray(bits_a, np.int64).reshape(-1, 2), np.asarray(bits_b, np.int64).reshape(-1, 2)
    if min(len(a), len(b)) < CONSENSUS:
        return False
    i, j, least = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    back, best = np.zeros(len(b), np.int64), np.full(len(b), 1 << 10)
    for lo in range(0, len(a), 512):  # large pictures have many corners
        far = np.bitwise_count(a[lo : lo + 512, None, 0] ^ b[None, :, 0]).astype(np.int64) + np.bitwise_count(a[lo : lo + 512, None, 1] ^ b[None, :, 1])
        j[lo : lo + 512], least[lo : lo + 512] = far.argmin(1), far.min(1)
        low = far.min(0)
        back, best = np.where(low < best, lo + far.argmin(0), back), np.minimum(low, best)
    i = i[(least <= NEAR) & (back[j] == i)]
    if len(i) < CONSENSUS:
        return False
    ay, ax, az, at = _unpack_spots(np.asarray(spots_a, np.int64)[i])
    by, bx, bz, bt = _unpack_spots(np.asarray(spots_b, np.int64)[j[i]])
    zoom, turn = np.rint((az - bz) * 3) / 3, (bt - at) % (2 * np.pi)
    steps, size = np.rint(turn * (6 / np.pi)).astype(int) % 12, 2.0**zoom
    dy = (by - size * (ay * np.cos(turn) + ax * np.sin(turn))) / 24
    dx = (bx - size * (ax * np.cos(turn) - ay * np.sin(turn))) / 24
    # two grids of shifts, half a cell apart, so that a border cuts no consensus
    for off in (0, 0.5):
        cells = Counter(zip(zoom.tolist(), steps.tolist(), np.floor(dy + off).tolist(), np.floor(dx + off).tolist(), strict=True))
        if max(cells.values()) >= CONSENSUS:
            return True
    return False


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those u, v of pairs whose images agree."""
    side = lambda k: found.select(F.col("id").alias(k), F.col("spots").alias(f"spots_{k}"), F.col("bits").alias(f"bits_{k}"))

    def run(batches):
        for batch in small(batches, 256):
            columns = [batch.column(c) for c in ("spots_u", "bits_u", "spots_v", "bits_v")]
            good = [agree(*(c[i].values.to_numpy() for c in columns)) for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def match(found: DataFrame) -> DataFrame:
    """u, v: pairs of images that agree and, between them, join all candidates that do.

    Each image is first held against the first member of its cells with which it shares most of them. Then all
    pairs of a cell's members in different classes are counted: in a cell full of copies only members outside
    the class of its first one meet the others, so copies cost one row each.
    """
    rows = cell_rows(found)
    first = rows.groupBy("cell").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("cell", "hub")
    shared = durable(rows.join(first, "cell"))
    hubs = shared.where("id <> hub").groupBy("hub", "id").agg(F.count("*").alias("n")).where(F.col("n") >= HITS)
    best = hubs.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("best")).select(F.col("best.hub").alias("u"), F.col("id").alias("v"))
    links = durable(verify(durable(best), found))
    root = sized(durable(components(links)))
    at = lambda k: root.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    classed = shared.join(at("id"), "id", "left").join(at("hub"), "hub", "left")
    classed = classed.select("cell", "id", F.coalesce("root_id", "id").alias("own"), F.coalesce("root_hub", "hub").alias("major"))
    strangers = classed.where("own <> major").select("cell", F.col("id").alias("x"), F.col("own").alias("own_x"))
    met = strangers.join(classed, "cell").where("own <> own_x and (own = major or own_x < own)")
    pairs = met.groupBy(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= HITS)
    return links.union(verify(durable(pairs.select("u", "v")), found))


def image_copies(images: DataFrame, key: str = "image_id", column: str = "image") -> DataFrame:
    """image_id, n_joined, class_id, kept: one row per row of images.

    class_id is the smallest image_id reachable by links, n_joined how many of the links that were verified hold
    the image (pairs already in one class are not all compared; equal bytes link with their first
    image). Null, empty and unreadable bytes are no image and link with nothing, equal or not.
    image_id is the key: repeated rows are one image; a null key is returned, unlinked; extra columns
    are ignored; an empty table gives no rows. Memory and work of an image are linear in its pixels, but for the
    comparison of two images' corners, which takes blocks of bounded size.
    """
    rows = images.select(F.col(key).cast("long").alias("image_id"), F.col(column).alias("image"))
    found = durable(descriptors(rows, "image_id", "image"))
    same = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("rep"))
    same = durable(same.select("h1", "h2", F.col("rep.id").alias("rep"), F.col("rep.row").alias("row")))
    members = found.select("id", "h1", "h2").join(same, ["h1", "h2"]).where("id <> rep").select("rep", "id").distinct()
    reps = durable(found.join(same, "row", "left_semi").select("id", "spots", "bits"))
    links = durable(match(reps).union(members.select(F.col("rep").alias("u"), F.col("id").alias("v"))))
    degree = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("at")).agg(F.count("*").alias("n"))
    roots = components(links)
    return rows.select("image_id").join(degree, F.col("image_id") == degree["at"], "left").join(roots, F.col("image_id") == roots["node"], "left").select(
        "image_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_joined"), F.coalesce("root", "image_id").alias("class_id"),
        F.col("image_id").eqNullSafe(F.coalesce("root", "image_id")).alias("kept"),
    )


def _waves(n: int, side: int = 72) -> np.ndarray:
    """(n, side, side): one plane wave a component, of fixed random direction, length and phase."""
    rng = np.random.default_rng(3)
    y, z = np.mgrid[:side, :side]
    turn, length, phase = rng.uniform(0, np.pi, n), rng.uniform(6, 24, n), rng.uniform(0, 2 * np.pi, n)
    along = np.cos(turn)[:, None, None] * y + np.sin(turn)[:, None, None] * z
    return np.cos(2 * np.pi * along / length[:, None, None] + phase[:, None, None])


_WAVES: dict[int, np.ndarray] = {}


def render(vector) -> bytes | None:
    """A vector as a picture: the sum of one plane wave a component; similar vectors look alike."""
    if not vector or None in vector or not np.isfinite(vector).all() or not np.any(vector):
        return None
    v = np.array(vector, np.float64)
    if len(v) not in _WAVES:
        _WAVES[len(v)] = _waves(len(v))
    picture = np.tensordot(v / np.abs(v).max(), _WAVES[len(v)], 1)
    return encode_pgm(128 + 110 * picture / max(np.abs(picture).max(), 1e-9))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no pictures, so each embedding is rendered as one: near copies of vectors are edited copies."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                pictures = [render(v) for v in batch.column(1)[lo : lo + 512].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 512], pa.array(pictures, pa.binary())], ["image_id", "image"])

    # describing a picture costs far more than the shuffle of its vector; the file alone would make few tasks of many
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(parts, "vec_id")
    return image_copies(vectors.mapInArrow(run, "image_id long, image binary"))
