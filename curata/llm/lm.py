"""Language-model scores: word counts over all training texts, and an attention model.

Texts are taken in units of up to ``UNIT_BYTES``, whose words and token ids are written
once. Ids are counted over all training texts, and the network is fitted on all of them.
A unit yields one row of its own (its texts' words as numbers into the unit's list of
distinct words) and a row for each distinct word with its count in training texts. These meet by word, which sums the
counts, and go back to their unit in packs; there each text's score is summed. So a
word is shuffled once a unit, not once a text, and no task holds more than a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm import attention, bpe
from curata.llm import common as c
from curata.llm import pieces as pc
from curata.llm.quality import held_out

UNIT_BYTES = 4 << 20
#: The network is fitted on all training ids, a part for each unit. A ``FIT_PART`` above 1 is for trials: one in so many ids, in parts of ``SAMPLE_IDS``.
FIT_PART, SAMPLE_IDS, LEAST_PARTS = 1, 1 << 20, 4
#: In each of ``ROUNDS`` every part takes steps from the same state, and the mean of the results is the next one. Over all rounds a part's
#: windows are each taken once at least; with few parts there are ``ROUND_STEPS`` a round, so small inputs are gone over again.
ROUNDS, ROUND_STEPS, BATCH = 16, 150, 96
_VALUES = c.byte_values(8)


def _id_type(n_ids: int) -> type:
    """Ids are held as bytes, which the JVM passes on without a look at each."""
    return np.uint16 if n_ids <= 1 << 16 else np.uint32


def _ids_of(batch: pa.RecordBatch, k: int, n_ids: int) -> np.ndarray:
    return np.frombuffer(batch.column("ids")[k].as_buffer(), _id_type(n_ids))


def id_counts(units: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs in all training texts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _ids_of(batch, k, n_ids)
                sizes, held = (batch.column(x)[k].values.to_numpy(zero_copy_only=False) for x in ("id_sizes", "held"))
                total += np.bincount(ids[np.repeat(~held.astype(bool), sizes)], minlength=n_ids)
        c.release()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for k, n in units.select("held", "ids", "id_sizes").mapInArrow(apply, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[k] = n
    return out


def _drawn(units: DataFrame, share: float, parts: int, n_ids: int) -> DataFrame:
    """``part, draw, ids`` of the training texts whose draw is in the share, dealt in parts by it."""
    limit, scale = max(1, round(share * 1_000_000)), 1_000_000

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _ids_of(batch, k, n_ids)
                sizes, held, draws = (batch.column(x)[k].values.to_numpy(zero_copy_only=False) for x in ("id_sizes", "held", "draws"))
                ends, place = np.cumsum(sizes), draws % scale
                rows = np.flatnonzero(~held.astype(bool) & (place < limit))
                lists = pa.array([ids[ends[x] - sizes[x] : ends[x]].astype(np.int32) for x in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array((place[rows] * parts // limit).astype(np.int32)), pa.array(draws[rows]), lists], names=["part", "draw", "ids"])

    return units.select("held", "ids", "id_sizes", "draws").mapInArrow(apply, "part int, draw long, ids array<int>")


def _training(batch: pa.RecordBatch, k: int, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a unit's training texts in a row, and the number of each text's."""
    ids = _ids_of(batch, k, n_ids)
    sizes, held = (batch.column(x)[k].values.to_numpy(zero_copy_only=False) for x in ("id_sizes", "held"))
    train = ~held.astype(bool)
    return ids[np.repeat(train, sizes)], sizes[train]


def unit_parts(units: DataFrame, n_ids: int) -> DataFrame:
    """``part, ids, sizes`` of all training texts, a row for each unit."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = _training(batch, k, n_ids)
                yield pa.RecordBatch.from_arrays([batch.column("unit").slice(k, 1), pa.array([ids.astype(np.int32).tobytes()]), pa.array([sizes], pa.list_(pa.int32()))], names=["part", "ids", "sizes"])
        c.release()

    return units.select("unit", "held", "ids", "id_sizes").mapInArrow(apply, "part long, ids binary, sizes array<int>").where(F.size("sizes") > 0)


def drawn_parts(units: DataFrame, counts: np.ndarray) -> tuple[DataFrame, int]:
    """``part, ids, sizes`` of the texts that the network is fitted on, a row for each part, and the number of parts."""
    if FIT_PART == 1:
        return unit_parts(units, len(counts)), units.count()
    total = max(1, int(counts.sum()))
    share = min(1.0, max(LEAST_PARTS * SAMPLE_IDS, total / FIT_PART) / total)
    parts = max(1, round(share * total / SAMPLE_IDS))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def packed() -> pa.RecordBatch:
            flat, sizes = np.concatenate([np.zeros(0, np.int32), *held]), np.array([len(x) for x in held], np.int32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat.astype(np.int32).tobytes()]), pa.array([sizes], pa.list_(pa.int32()))], names=["part", "ids", "sizes"])

        for batch in batches:
            for k, number in enumerate(batch.column("part").to_pylist()):
                if number != part and held:
                    yield packed()
                    held = []
                part = number
                held.append(batch.column("ids")[k].values.to_numpy(zero_copy_only=False).copy())
        if held:
            yield packed()
        held = []
        c.release()

    drawn = _drawn(units, share, parts, len(counts)).repartition(min(parts, 4096), "part").sortWithinPartitions("part", "draw")
    return c.cut(drawn.mapInArrow(apply, "part int, ids binary, sizes array<int>"), large_rows=True), parts


def _sum(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row ``n, state`` with the sums of all, or none."""
    n, total = 0, None
    for k, state in rows:
        n, total = n + k, state.astype(np.float32) if total is None else total + state
    c.release()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "state"])


def trained_on(m: attention.Model, state: np.ndarray, number: int, least: int, part: int, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The state after a part's steps of round ``number``: its share of the part's windows, and ``least`` steps at least."""
    count = int(attention.window_counts(sizes + 1).sum())
    steps = max(least, -(-count // (ROUNDS * BATCH)))
    return attention.advance(m, state, *attention.sequence(m, ids, sizes), number * steps, steps, ROUNDS * steps, [8, part], BATCH)


def _round(drawn: DataFrame, m: attention.Model, state: np.ndarray, number: int, parts: int) -> np.ndarray:
    """The mean of the states that the parts reach from ``state``; sums meet 16 at a time, so the driver gets 16 at most.

    ``drawn``: rows as ``drawn_parts`` has them, or units, which are then taken as parts in the same pass.
    """
    whole = "held" in drawn.columns
    drawn = drawn.select("unit", "held", "ids", "id_sizes") if whole else drawn
    context = drawn.sparkSession.sparkContext
    sent, least = context.broadcast((m, state)), -(-ROUND_STEPS * LEAST_PARTS // max(parts, LEAST_PARTS))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states() -> Iterator[tuple[int, np.ndarray]]:
            m, state = sent.value
            for batch in batches:
                for k, part in enumerate(batch.column(0).to_pylist()):
                    ids, sizes = _training(batch, k, len(m.class_of)) if whole else (np.frombuffer(batch.column("ids")[k].as_buffer(), np.int32), batch.column("sizes")[k].values.to_numpy())
                    if len(sizes):
                        yield 1, trained_on(m, state, number, least, part, ids, sizes.astype(np.int64))

        yield from _sum(states())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sum((n.as_py(), np.frombuffer(x.as_buffer(), np.float32)) for b in batches for n, x in zip(b.column("n"), b.column("state"), strict=True))

    sums = drawn.mapInArrow(trained, "n long, state binary")
    while parts > 16:
        parts = -(-parts // 16)
        sums = sums.repartition(parts).mapInArrow(summed, "n long, state binary")
    rows = sums.collect()
    sent.unpersist()
    if not rows:
        return state
    total = np.sum([np.frombuffer(x.state, np.float32) for x in rows], 0, dtype=np.float64)
    return (total / sum(x.n for x in rows)).astype(np.float32).reshape(state.shape)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, units: DataFrame | None = None) -> attention.Model:
    """Classes, shares and the network from all training texts.

    Parts grow in number with the corpus, and Spark's tasks train on one at a time;
    the driver only has the state of the network. Without training texts it stays as it began.
    """
    path = path or public_tokenizers.path(bpe.VOCABULARY)
    units = encoded(docs, doc_id, text, path) if units is None else units
    v = bpe.vocabulary(path)
    counts = id_counts(units, len(v.lengths))
    spaced = (v.lengths > 0) & (v.bytes[np.minimum(v.begins, len(v.bytes) - 1)] == 32)
    drawn, parts = (units, units.count()) if FIT_PART == 1 else drawn_parts(units, counts)
    m = attention.begin(counts.astype(float), spaced.astype(int))
    state = attention.state_of(m)
    for number in range(ROUNDS):
        state = _round(drawn, m, state, number, parts)
    return attention.with_state(m, state)


def _unit(texts: pa.Array, train: np.ndarray, v: bpe.Vocabulary) -> dict:
    """Everything of a unit: word numbers and token ids of each text."""
    hashes, rows, counts, numbers, cuts, index = [], [], [], [], [np.zeros(1, np.int64)], pc.PieceIndex()
    first, tokens = 0, 0
    for part in c.slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
        data, offsets = c.utf8(part.column("t"))
        low = c.LOWER[data]
        starts, ends, row = c.spans(c.SPACE_WORD[low], offsets)
        h = c.span_hashes(low, starts, ends, _VALUES).view(np.int64)
        hashes.append(h)
        rows.append(row + first)
        counts.append(c.row_counts(row, part.num_rows))
        first += part.num_rows
        plain = ["" if t is None else t for t in part.column("t").to_pylist()]
        joined = "".join(plain)
        cps = pc.points(joined)
        stop = np.cumsum([len(t) for t in plain])
        begin = bpe.split(cps, np.concatenate([[0], stop[:-1]])) if len(cps) else np.zeros(0, np.int64)
        if len(cps):
            numbers.append(index.add(joined, cps, begin, np.append(begin[1:], len(cps))))
        cuts.append(tokens + np.searchsorted(begin, stop))
        tokens += len(begin)
    word = np.concatenate(hashes)
    row = np.concatenate(rows)
    unique, inverse = np.unique(word, return_inverse=True)
    weight = np.bincount(inverse, weights=train[row], minlength=len(unique)).astype(np.int64)
    # Numbers by falling count in the unit are small where they are frequent.
    order = np.argsort(-np.bincount(inverse, minlength=len(unique)), kind="stable")
    place = np.empty(len(unique), np.int64)
    place[order] = np.arange(len(unique))
    ids, per_piece = bpe.encode_pieces(index, v)
    at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    begin = np.cumsum(per_piece) - per_piece
    total = np.concatenate([[0], np.cumsum(per_piece[at])])
    flat = ids[np.repeat(begin[at] - total[:-1], per_piece[at]) + np.arange(total[-1])]
    ends = total[np.concatenate(cuts)]
    return {"words": unique[order], "weights": weight[order], "numbers": place[inverse].astype(np.int32), "sizes": np.concatenate(counts), "ids": flat, "id_sizes": np.diff(ends)}


def _scored(m: attention.Model, ids: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """``attention.score`` over runs of texts of about ``most`` ids."""
    out, row, ends = np.zeros(len(sizes)), 0, np.concatenate([[0], np.cumsum(sizes)])
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        out[row:stop] = attention.score(m, ids[ends[row] : ends[stop]], sizes[row:stop])
        row = stop
    return out


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``unit, doc_ids, held, draws, sizes, numbers, ids, id_sizes`` of each unit and its ``words, weights``, written once."""
    path, table = path or public_tokenizers.path(bpe.VOCABULARY), pc.packed()
    schema = "unit long, doc_ids array<long>, held array<boolean>, draws array<long>, sizes array<int>, numbers array<int>, ids binary, id_sizes array<int>, words array<long>, weights array<long>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pc.unpack(table)
        v, waiting, size, made = bpe.vocabulary(path), [], 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            held = whole.column("held").to_numpy().astype(bool)
            u = _unit(whole.column("text").combine_chunks(), ~held, v)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + made], pa.int64()), one(whole.column("doc_id").to_pylist(), pa.int64()), one(held, pa.bool_()), one(whole.column("draw").to_numpy(), pa.int64()), one(u["sizes"].astype(np.int32), pa.int32()),
                one(u["numbers"], pa.int32()), pa.array([u["ids"].astype(_id_type(len(v.lengths))).tobytes()], pa.binary()), one(u["id_sizes"].astype(np.int32), pa.int32()), one(u["words"], pa.int64()), one(u["weights"], pa.int64()),
            ], names=["unit", "doc_ids", "held", "draws", "sizes", "numbers", "ids", "id_sizes", "words", "weights"])

        for whole in batches:
            for batch in c.slices(whole, "text"):
                waiting.append(batch)
                size += int(c.utf8(batch.column("text"))[1][-1])
                if size >= UNIT_BYTES:
                    yield flush()
                    waiting, size, made = [], 0, made + 1
                    c.release()
        if waiting:
            yield flush()
        waiting = []
        c.release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, 10).alias("held"), F.xxhash64(F.col(doc_id).cast("string"), F.lit(8)).alias("draw"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return c.cut(rows.mapInArrow(apply, schema), large_rows=True)


def _unit_scores(units: DataFrame, m: attention.Model) -> DataFrame:
    """``unit, scores``: the model's score of each text of a unit."""
    sent = units.sparkSession.sparkContext.broadcast(m)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = _ids_of(batch, k, len(sent.value.class_of)), batch.column("id_sizes")[k].values.to_numpy()
                scores = _scored(sent.value, ids, sizes.astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("unit").slice(k, 1), pa.array([scores], pa.list_(pa.float64()))], names=["unit", "scores"])

    return units.select("unit", "ids", "id_sizes").mapInArrow(apply, "unit long, scores array<double>")


def _packed(counted: DataFrame) -> DataFrame:
    """``unit, at, n`` in packs: places in a unit's word list and the words' counts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pack() -> pa.RecordBatch:
            x = np.concatenate(held)
            x = x[np.argsort(x[:, 0], kind="stable")]
            units, first = np.unique(x[:, 0], return_index=True)
            size = pa.array(np.append(first, len(x)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(size, pa.array(np.ascontiguousarray(x[:, k]).astype(kind))) for k, kind in ((1, np.int32), (2, np.int64))]
            new = np.add.reduceat(x[:, 3], first)
            return pa.RecordBatch.from_arrays([pa.array(units), *lists, pa.array(new)], names=["unit", "at", "n", "fresh"])

        rows = 0
        for b in batches:
            held.append(np.stack([np.asarray(b.column(k)) for k in ("unit", "at", "c", "fresh")], 1))
            rows += b.num_rows
            if rows >= 400_000:
                yield pack()
                held.clear()
                rows = 0
        if held and rows:
            yield pack()

    return counted.mapInArrow(apply, "unit long, at array<int>, n array<long>, fresh long")


def score(docs: DataFrame, m: attention.Model, doc_id: str = "doc_id", text: str = "text", path: str | None = None, units: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are the lower-cased words and one end. Training texts are those whose crc32
    of the id's text is not divisible by 10; rows with a null id are training texts.
    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, ``score`` is
    the attention model's log10 probability of the text. A null or empty text has one
    token, the end. Repeated rows count and are scored each; no rows give no rows.
    ``units``: the texts as ``encoded``, if at hand.
    """
    units = encoded(docs, doc_id, text, path) if units is None else units
    scored = c.cut(_unit_scores(units, m))
    words = units.select("unit", F.posexplode(F.arrays_zip("words", "weights")).alias("at", "w")).select("unit", "at", F.col("w.words").alias("word"), F.col("w.weights").alias("weight"))
    by_word = Window.partitionBy("word")
    counted = words.select("unit", "at", F.sum("weight").over(by_word).alias("c"), F.row_number().over(by_word.orderBy("unit")).alias("k"))
    packs = c.cut(_packed(counted.select("unit", "at", "c", ((F.col("k") == 1) & (F.col("c") > 0)).cast("long").alias("fresh"))), large_rows=True)
    n_words, n_texts = units.select(F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x).alias("w"), F.size(F.filter("held", lambda x: ~x)).alias("t")).agg(F.sum("w"), F.sum("t")).first()
    texts = n_texts or 0
    total = (n_words or 0) + texts
    distinct = (packs.agg(F.sum("fresh")).first()[0] or 0) + (texts > 0)
    spread = total + 0.1 * (distinct + 1)
    names = ["doc_ids", "held", "sizes", "numbers"]
    kinds = {x: units.schema[x].dataType for x in names} | {"scores": scored.schema["scores"].dataType, "at": packs.schema["at"].dataType, "n": packs.schema["n"].dataType}
    rows = lambda df, kind: df.select("unit", F.lit(kind).alias("kind"), *[F.col(x) if x in df.columns else F.lit(None).cast(k).alias(x) for x, k in kinds.items()])
    both = rows(scored, 0).unionByName(rows(units, 1)).unionByName(rows(packs, 2)).repartition("unit").sortWithinPartitions("unit", "kind")
    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(unit: dict | None, known: np.ndarray | None) -> pa.RecordBatch | None:
        if unit is None:
            return None
        sizes, number = np.array(unit["sizes"], np.int64), unit["numbers"]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        end = np.log10((texts + 0.1) / spread)
        cs = known[number]
        base = np.bincount(rows, weights=np.log10((cs + 0.1) / spread), minlength=len(sizes)) + end
        seen = np.bincount(rows, weights=cs > 0, minlength=len(sizes)).astype(np.int64) + (texts > 0)
        held = np.array(unit["held"], bool)
        return pa.RecordBatch.from_arrays([pa.array(unit["doc_ids"], pa.int64()), pa.array(held), pa.array(sizes + 1), pa.array(seen), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(np.array(unit["scores"], float))], names=out_names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, known, scores = None, None, None
        for b in batches:
            kinds = b.column("kind").to_pylist()
            for k, kind in enumerate(kinds):
                if kind == 0:
                    scores = b.column("scores")[k].values.to_numpy(zero_copy_only=False).copy()
                elif kind == 1:
                    if (done := finish(unit, known)) is not None:
                        yield done
                    unit = {x: b.column(x)[k].values.to_numpy(zero_copy_only=False) if x != "doc_ids" else b.column(x)[k].as_py() for x in names} | {"scores": scores}
                    known = np.zeros(int(unit["numbers"].max(initial=-1)) + 1, np.int64)
                else:
                    known[b.column("at")[k].values.to_numpy()] = b.column("n")[k].values.to_numpy()
        if (done := finish(unit, known)) is not None:
            yield done

    return both.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; null texts have one token, the end, rows with null ids are training texts, repeated rows count and are scored each."""
    docs = c.table(spark, sf_dir, "documents")
    units = encoded(docs)
    return score(docs, fit(docs, units=units), units=units)
