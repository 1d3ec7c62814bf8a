"""Near-duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find grouping.

1. Every whole text becomes a set of hashed word shingles, its digest, and a SuperMinHash signature.
2. Texts of the same set form a class; from here on only one row of each class takes part.
3. Bands of the signature deal classes into buckets. Each class is paired with the smallest set of its
   bucket, so a bucket of n classes gives n - 1 pairs. Pairs whose signatures exclude the wanted
   similarity go; the rest are confirmed on the whole sets. Components follow from the links.
4. In large stars that reach into several components, the member closest to what most have is paired
   with all others, too. Stars whose members are still in several components are looked through again, in blocks of bounded
   size, for pairs across components. In large ones, where texts have much in common, only members
   are compared that share something rare or that differ little from what most have; this loses no pair.
   Signatures give lists of members in likely pairs; whole sets are brought to lists and compared there,
   and of the similar pairs only as many are returned as tie the components together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import discard, map_columns, materialise, release_memory, small_batches
from spanloom.llm.graph import connected_components

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Members of a key that are compared in one block, and about how many shingles they may have together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Stars of up to so many members are compared directly; so many show the centre of a larger one.
SMALL_STAR, CENTRE_MEMBERS = 32, 16
#: Elements whose permutations are kept in memory at once while a signature is made.
_ELEMENTS = 4096
#: Standard deviations of the signature's estimate that a pair may fall short.
_SLACK = 6.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; all words as one if there are fewer.

    Words are runs without ASCII white space, with A-Z in lower case, as bytes know it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, "uint64")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, "uint64")
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + count])
    return np.unique(out)


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: each element deals its ranks 0, 1, 2, … to the slots of a permutation of its own.

    A slot keeps the least of rank plus a random fraction, here 64-bit integers with the rank in the
    upper half. Elements stop as soon as their rank exceeds what every slot holds.
    """
    best = np.full(slots, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(elements), _ELEMENTS):
        part = elements[at : at + _ELEMENTS]
        rows = np.arange(len(part))
        order = np.tile(np.arange(slots, dtype="uint16"), (len(part), 1))
        for rank in range(slots):
            if int(best.max()) >> 32 < rank:
                break
            draw = _mixed(part + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            other = rank + ((draw >> np.uint64(33)) % np.uint64(slots - rank)).astype("int64")
            slot = order[rows, other]
            order[rows, other] = order[:, rank]
            np.minimum.at(best, slot, (np.uint64(rank) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF)))
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A 64-bit key for each band of the signature, different from band to band."""
    parts = signature.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype="uint64")
    for i in range(rows):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return keys.astype("int64").tolist()


def _place(doc_id: Column, text: Column) -> list[Column]:
    """What tells a row with another text apart, and rows of one text unless they lack an id: the id and 128 hashed bits."""
    return [F.coalesce(doc_id, F.lit(0)).alias("id0"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, the row's place, set size, digest, and for non-empty sets the signature's low bytes and band keys."""

    def sets(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: columns[name] for name in ("doc_id", "id0", "h1", "h2")} | {"n_shingles": [], "digest": [], "signature": [], "bands": []}
        for text in columns["text"]:
            elements = shingle_hashes(text)
            signature = super_minhash(elements) if len(elements) else None
            out["n_shingles"].append(len(elements))
            out["digest"].append(xxhash.xxh3_128_digest(elements.tobytes()))
            out["signature"].append(None if signature is None else signature.astype("uint8").tobytes())
            out["bands"].append(None if signature is None else band_keys(signature))
        return out

    rows = docs.select("doc_id", *_place(F.col("doc_id"), F.col("text")), "text")
    return map_columns(rows, sets, "doc_id long, id0 long, h1 long, h2 long, n_shingles long, digest binary, signature binary, bands array<long>")


def _likely(n_a: np.ndarray, n_b: np.ndarray, same: np.ndarray, percent: int) -> np.ndarray:
    """Whether set sizes allow the similarity, and equal signature bytes don't exclude it."""
    t = percent / 100
    least = SLOTS * t - _SLACK * np.sqrt(SLOTS * t * (1 - t))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (same >= least)


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that may be similar enough, by their sizes and signatures."""
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                first, second = (np.frombuffer(b"".join(part.column(c).to_pylist()), "uint8").reshape(-1, SLOTS) for c in ("s_a", "s_b"))
                sizes = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                yield part.select(["a", "b"]).filter(pa.array(_likely(*sizes, (first == second).sum(axis=1), percent)))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(keep, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct classes of pairs: ``class``."""
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def class_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """A text of each wanted class: ``class``, ``text``. Texts are dealt out once, by the places of their rows, so copies don't meet."""
    places = ["id0", "h1", "h2"]
    named = docs.filter(F.length("text") > 0).select(*_place(F.col("doc_id"), F.col("text")), "text")
    found = classes.select("class", "place.*").join(wanted, "class").join(named, places)
    return found.dropDuplicates([*places, "class"]).select("class", "text")


def confirmed_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough; texts are brought only to classes that are in a pair.

    A join on a class in very many pairs can be split, so such a class is no hot spot.
    """
    chosen = materialise(texts.join(ends(pairs), "class"))
    side = lambda s: chosen.select(F.col("class").alias(s), F.col("text").alias(f"t_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    seen: dict[int, np.ndarray] = {}

    def check(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, text_a, text_b in zip(*(columns[c] for c in ("a", "b", "t_a", "t_b")), strict=True):
            if a not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[a] = shingle_hashes(text_a)
            first, second = seen[a], shingle_hashes(text_b)
            common = np.intersect1d(first, second, assume_unique=True).size
            if 100 * common >= percent * (len(first) + len(second) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    found = materialise(map_columns(both.select("a", "b", "t_a", "t_b"), check, "a long, b long"))
    discard(chosen)
    return found


def star_centres(members: DataFrame, texts: DataFrame) -> DataFrame:
    """What most members of each star have: ``a`` and ``centre``, sorted hashes as bytes.

    A few members of each star, chosen by hash, are looked at. Any set would do as a centre; the
    closer it is to the members, the fewer pairs are compared.
    """
    order = Window.partitionBy("a").orderBy(F.xxhash64("b"))
    few = members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= CENTRE_MEMBERS).select("a", F.col("b").alias("class"))
    gathered = few.join(texts, "class").groupBy("a").agg(F.collect_list("text").alias("texts"))

    def most(columns: dict[str, list]) -> dict[str, list]:
        centres = []
        for found in columns["texts"]:
            hashes, times = np.unique(np.concatenate([shingle_hashes(text) for text in found]), return_counts=True)
            centres.append(hashes[2 * times > len(found)].tobytes())
        return {"a": columns["a"], "centre": centres}

    return map_columns(gathered, most, "a long, centre binary", rows=20)


def star_members(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Members of large stars beside their centre: ``a``, ``b``, ``first`` (how many shingles can be keys), ``inside`` (how many the centre has), ``rest`` (the others) and ``near`` (similarity to the centre)."""
    centres = materialise(star_centres(members, texts))
    both = members.select("a", "b").join(texts.select(F.col("class").alias("b"), "text"), "b").join(centres, "a")

    def rest(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": columns["a"], "b": columns["b"], "first": [], "inside": [], "rest": [], "near": []}
        for centre, text in zip(columns["centre"], columns["text"], strict=True):
            own, middle = shingle_hashes(text), np.frombuffer(centre, "uint64")
            outside = np.setdiff1d(own, middle, assume_unique=True)
            inside = len(own) - len(outside)
            out["first"].append(len(own) - (percent * len(own) + 99) // 100 + 1)
            out["inside"].append(inside)
            out["rest"].append(outside.astype("int64"))
            out["near"].append(inside / (len(middle) + len(outside)))
        return out

    return materialise(map_columns(both.select("a", "b", "centre", "text"), rest, "a long, b long, first int, inside long, rest array<long>, near double"))


def star_keys(rests: DataFrame) -> DataFrame:
    """Similar members of one star share a key, see :func:`residual_pairs`: ``key``, ``class``, and ``inside``, which is -1 for keys that are shingles."""
    listed = rests.select("a", "b", F.explode("rest").alias("key"))
    counts = listed.groupBy("a", "key").agg(F.count("*").alias("times")).filter("times > 1")
    shared = listed.join(counts, ["a", "key"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("shared"))
    # shingles that no other member has come first in the order and are no keys
    left = F.col("first") - (F.size("rest") - F.size("shared"))
    outside = rests.join(shared, ["a", "b"]).filter(left > 0).select("a", F.col("b").alias("class"), F.explode(F.slice("shared", F.lit(1), left)).alias("s"))
    outside = outside.select(F.xxhash64("a", "s.key").alias("key"), "class", F.lit(-1).cast("long").alias("inside")).distinct()
    return outside.unionByName(rests.select(F.xxhash64("a").alias("key"), F.col("b").alias("class"), "inside"))


def compared(members: DataFrame, percent: int) -> DataFrame:
    """Lists ``classes`` among the members of each ``key`` that likely pairs across components tie together.

    ``members`` has ``key``, ``class``, ``component``, ``n_shingles``, ``signature`` and ``inside``. The
    members of a key's largest component meet only the others; both are dealt to blocks, and each two
    blocks are compared by themselves. So no task gathers more than two blocks, and no pair is left out:
    both of its classes are in one list. Of each two blocks, a class is in one list at most, however many
    likely pairs it is in.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    plan = keys.select("key", F.col("top.component").alias("major"), blocks(F.col("top.n"), F.col("top.shingles")).alias("major_blocks"), blocks(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("minor_blocks"))
    plan = materialise(plan)  # as a table, the join with it can be split where a key has very many members
    row = F.struct("class", "component", "n_shingles", "inside", "signature").alias("member")
    dealt = members.join(plan, "key").withColumns({"is_major": F.col("component") == F.col("major"), "deal": F.pmod(F.xxhash64("class"), F.lit(1 << 30))})
    own = F.when(F.col("is_major"), -1 - F.pmod("deal", F.col("major_blocks"))).otherwise(F.pmod("deal", F.col("minor_blocks")))
    minors = F.sequence(F.lit(0), F.col("minor_blocks") - 1)
    others = F.when(F.col("is_major"), minors).otherwise(F.concat(minors, F.sequence(-F.col("major_blocks"), F.lit(-1))))
    met = dealt.select("key", own.cast("int").alias("own"), row, F.explode(others).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "member")
    # without this, rows would stay as the join on the key left them: all blocks of a key in one task
    groups = met.repartition("key", "i", "j").groupBy("key", "i", "j").agg(F.collect_list("member").alias("members"))

    def compare(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"classes": []}
        for found in columns["members"]:
            ids, parts, n, inside = (np.array([m[name] for m in found]) for name in ("class", "component", "n_shingles", "inside"))
            signatures = np.frombuffer(b"".join(m["signature"] for m in found), "uint8").reshape(-1, SLOTS)
            tied = np.arange(len(ids))
            for i in range(len(ids) - 1):
                rest = slice(i + 1, None)
                common = np.where(inside[rest] < 0, np.minimum(n[i], n[rest]), np.minimum(inside[i], inside[rest]))
                near = ((parts[rest] != parts[i]) & (100 * common >= percent * (n[i] + n[rest] - common))).nonzero()[0] + i + 1
                if len(near):
                    good = near[_likely(n[i], n[near], (signatures[near] == signatures[i]).sum(axis=1), percent)]
                    if (tied[good] != tied[i]).any():
                        tied[np.isin(tied, tied[good])] = tied[i]
            names, sizes = np.unique(tied, return_counts=True)
            out["classes"] += [np.sort(ids[tied == name]).tolist() for name in names[sizes > 1]]
        return out

    # members that share one passage have one list under each of its shingles
    return map_columns(groups.select("members"), compare, "classes array<long>", rows=20).distinct()


def _links_among(ids: list[int], parts: list[int], signatures: list[bytes], sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Pairs of similar sets that tie together all components that such pairs tie; whole sets are compared."""
    joined, n = np.array(parts), np.array([len(found) for found in sets])
    bytes_ = np.frombuffer(b"".join(signatures), "uint8").reshape(-1, SLOTS)
    hashes, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(places, np.cumsum(n)[:-1])
    own = np.zeros(len(hashes), bool)
    first, second = [], []
    for i in range(len(ids) - 1):
        near = (joined[i + 1 :] != joined[i]).nonzero()[0] + i + 1
        good = near[_likely(n[i], n[near], (bytes_[near] == bytes_[i]).sum(axis=1), percent)]
        own[places[i]] = True
        for j in good.tolist():
            if joined[j] != joined[i]:
                common = np.count_nonzero(own[places[j]])
                if 100 * common >= percent * (n[i] + n[j] - common):
                    joined[joined == joined[j]] = joined[i]
                    first.append(min(ids[i], ids[j]))
                    second.append(max(ids[i], ids[j]))
        own[places[i]] = False
    return first, second


def confirmed_links(lists: DataFrame, members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links that whole sets confirm among the classes of each list: ``a``, ``b``, fewer than the list has classes.

    ``members`` has ``class``, ``component`` and ``signature``. Texts are brought to lists, not to pairs,
    and a task holds the sets of one list at a time, which :func:`compared` bounds. Pairs of a list
    are only passed over if their signatures exclude them or links already tie their components.
    """
    numbered = materialise(lists.withColumn("list", F.monotonically_increasing_id()))
    listed = materialise(numbered.select("list", F.explode("classes").alias("class")))
    chosen = materialise(members.join(listed.select("class").distinct(), "class").join(texts, "class"))
    both = listed.join(chosen, "class").select("list", "class", "component", "signature", "text").repartition("list").sortWithinPartitions("list")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            ids, parts, signatures, sets = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in _links_among(ids, parts, signatures, sets, percent)], ["a", "b"])

        for part in small_batches(batches):
            for number, *row, text in zip(*(part.column(c).to_pylist() for c in ("list", "class", "component", "signature", "text")), strict=True):
                if held and number != at:
                    yield found()
                    held.clear()
                at = number
                held.append((*row, shingle_hashes(text)))
        if held:
            yield found()
        held.clear()
        release_memory()

    links = materialise(both.mapInArrow(check, "a long, b long").distinct())
    discard(numbered, listed, chosen)
    return links


def mixed_stars(stars: DataFrame, components: DataFrame) -> DataFrame:
    """Stars ``a`` whose members ``b`` are in several components, with the members' number and components."""
    placed = stars.join(components, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    mixed = placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low <> high").select("a", "members")
    return placed.join(mixed, "a")


def residual_links(held: DataFrame, keys: DataFrame | None, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """Links across components among the members of stars that are still mixed, enough to tie all that are similar; none if no pair is likely.

    Members of small stars are compared directly. For a large one, let c be a centre, for instance
    what most members have. Of two similar members, either all that they have in common lies in c, or
    not. In the first case they have no more in common than the fewer of their shingles in c, ``inside``,
    and few pairs pass this bound. In the second, order shingles by whether c has them, not first, and
    then by how many members do, few first: similar sets share their first common shingle among the
    first n - ceil(t·n) + 1 of each, and that lies outside c; so it serves as a key. No pair is lost.
    """
    keyed = held.filter(F.col("members") <= SMALL_STAR).select(F.xxhash64("a").alias("key"), F.col("b").alias("class"), F.lit(-1).cast("long").alias("inside"))
    if keys is not None:
        keyed = keyed.unionByName(keys)
    member = held.select(F.col("b").alias("class"), "component").distinct()
    member = member.join(classes.select("class", "n_shingles", "signature"), "class")
    members = materialise(keyed.join(member, "class"))
    lists = materialise(compared(members, percent))
    links = None if lists.isEmpty() else confirmed_links(lists, member.drop("n_shingles"), texts, percent)
    discard(members, lists)
    return links


def near_duplicates(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """Group rows whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the least ``doc_id`` that links reach, its
    own included) and ``kept`` (whether that is its own). A null or blank text has an empty set and
    is linked with nothing. Rows of a repeated id are rows of their own and may be in different
    groups; rows with a null id link like others, and a group without any id has a null
    ``component_id`` and keeps its rows. Other columns are left out; an empty table gives an empty
    result. At the threshold, banding misses a pair with a chance below 1e-5, once per class.
    """
    sets = materialise(document_sets(docs))
    classes = sets.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("id0", "h1", "h2")).alias("place"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()))
    buckets = classes.select(F.explode("bands").alias("key"), "class", "n_shingles")
    led = buckets.groupBy("key").agg(F.min(F.struct("n_shingles", "class")).alias("least"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("least.class").alias("a"))
    stars = materialise(buckets.join(led, "key").select("a", F.col("class").alias("b")).filter("a <> b").distinct())
    texts = materialise(class_texts(ends(stars), classes, docs))
    likely = materialise(likely_pairs(stars, classes, percent))
    links = confirmed_pairs(likely, texts, percent)
    components = materialise(connected_components(links, "a", "b"))
    held = materialise(mixed_stars(stars, components))
    discard(likely)
    large = materialise(held.filter(F.col("members") > SMALL_STAR).select("a", "b"))
    keys = rests = None
    if not large.isEmpty():
        rests = star_members(large, texts.join(large.select(F.col("b").alias("class")).distinct(), "class"), percent)
        # a second star from the member closest to the centre links most of what is similar
        closest = rests.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("closest"))
        second = rests.select("a", "b").join(closest, "a").filter("b <> closest").select(F.least("b", "closest").alias("a"), F.greatest("b", "closest").alias("b")).distinct()
        second = materialise(likely_pairs(second, classes, percent))
        links = links.unionByName(confirmed_pairs(second, texts, percent))
        older = (components, held, second)
        components = materialise(connected_components(links, "a", "b"))
        held = materialise(mixed_stars(stars, components))
        discard(*older)
        keys = star_keys(rests.join(held.select("a", "b"), ["a", "b"], "left_semi"))
    more = residual_links(held, keys, classes, texts, percent)
    if more is not None:
        components = materialise(connected_components(links.unionByName(more), "a", "b"))
    discard(stars, texts, held, large, rests, more)
    placed = classes.select("class", "digest", "doc_id").join(components, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(least, "component").select("digest", "component_id")
    out = sets.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(found, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one of each group of near-duplicates stays.

    That is the row of the group's least ``doc_id``; rows without an id come last, and of several rows
    of that id the first as numbered when the table is written here. Rows whose text has no words
    are linked with nothing and stay. An empty table stays empty.
    """
    whole = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("kept")))
    groups = near_duplicates(whole.select(F.col("row").alias("doc_id"), "kept.text"), percent=percent).select(F.col("doc_id").alias("row"), "component_id")
    placed = whole.select("row", F.col("kept.doc_id").alias("id")).join(groups, "row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return whole.select("row", "kept").join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("kept.*")
