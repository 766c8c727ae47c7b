"""Language-model scores of documents.

A causal self-attention model, trained in numpy on the subword ids of a public
vocabulary, predicts each subword from those before it: first its class, then,
by a tree of decisions, the subword itself. A document's subwords are those of
its words, each with the space before it. Counts of neighbouring subwords are
fixed terms of the model, to which training adds. Documents are dealt to shards
by a hash of id and text; a model is trained on windows of each shard, and the
parameters are averaged by what was seen, ROUNDS times; the rounds share out the
windows, so together they see every one once. Scores depend on the documents,
not on the tasks that read them. A document is scored in overlapping windows:
each subword is scored once, with the half window before it in view.

Beside it stands the base score, a smoothed unigram model of words whose
counts cover all training documents. Counts live in shards by word hash.
Words with at least one in HEAD of all occurrences, HEAD at most, are
broadcast; occurrences of all others go to their shards to be scored.
"""

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.attention import BRANCH, SPAN, Attention, Outputs, conditioned, factored, train
from ctispark.llm.common import pieces, read, staged
from ctispark.llm.shingles import word_hashes

CLASSES = 32
#: Each of ROUNDS rounds trains on one window in SHARE, other ones each, so on all of them together; BATCH at a time.
SHARE = ROUNDS = 4
BATCH = 128
#: Subwords of a shard that a model is trained on by itself, about; shards that may share a file, and files before any do.
TRAINED, FILE_SHARDS, FILES = 2_000_000, 16, 64
#: Positions of a window; parts by which parameters of tasks are summed, one for so many documents.
VIEW, FEWEST_PARTS, PART_DOCS = 32, 16, 1_000_000
HEAD = 1_000_000
#: Characters of texts that are parted into words and encoded at once, about.
SLICE = 8_000_000
#: Shards: one for so many documents, FEWEST_SHARDS at least.
SHARD_DOCS, FEWEST_SHARDS = 20_000, 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


_encoders: dict[str, object] = {}


def encoder(ranks: str):
    """This worker's encoder of a rank file."""
    if ranks not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("lm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, A-Z in lower case; which of them each word is, text behind text; and how many words each text has. They part at space and \\x09 to \\x0d, and at nothing else."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    empty = pc.equal(pc.binary_length(flat), 0)  # before leading and behind trailing white space
    if pc.any(empty).as_py():
        flat, owner = flat.filter(pc.invert(empty)), owner[~empty.to_numpy(zero_copy_only=False)]
    found = flat.dictionary_encode()
    return found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.bincount(owner, minlength=len(texts))


def word_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows (held, text). (shard, words, train, every, n_train, n_all, v): a shard's word hashes in order with their counts in training and in all documents, packed; and their sums."""
    bounds = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for held in (False, True):
                words, which, _ = words_of(batch.column(1).filter(pc.equal(batch.column(0), held)))
                h = word_hashes(words)
                order = np.argsort(h)
                h, n = h[order], np.bincount(which, minlength=len(words))[order]
                cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < b:
                        for c, x in zip(out, (k, held, h[a:b].tobytes(), n[a:b].astype(np.int64).tobytes()), strict=True):
                            c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["shard", "held", "words", "n"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in part.words])
        n = np.concatenate([np.frombuffer(b, np.int64) for b in part.n])
        own = np.repeat(~part.held.to_numpy(bool), [len(b) // 8 for b in part.words])
        words, at = np.unique(h, return_inverse=True)
        every, mine = np.bincount(at, n, len(words)).astype(np.int64), np.bincount(at, n * own, len(words)).astype(np.int64)
        return pd.DataFrame([{"shard": part.shard.iloc[0], "words": words.tobytes(), "train": mine.tobytes(), "every": every.tobytes(), "n_train": int(mine.sum()), "n_all": int(every.sum()), "v": int((mine > 0).sum())}])

    counted = rows.select("held", "text").mapInArrow(count, "shard long, held boolean, words binary, n binary")
    return staged(counted.groupBy("shard").applyInPandas(add, "shard long, words binary, train binary, every binary, n_train long, n_all long, v long"))


def frequent(shards: DataFrame, n_all: int, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and training counts of the words that are one in most of all n_all, so most of them at most."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, t, e in zip(batch.words, batch.train, batch.every, strict=True):
                hot = np.frombuffer(e, np.int64) * most >= n_all
                out.append({"words": np.frombuffer(w, np.uint64)[hot].tobytes(), "train": np.frombuffer(t, np.int64)[hot].tobytes()})
            yield pd.DataFrame(out, columns=["words", "train"])

    got = shards.select("words", "train", "every").mapInPandas(pick, "words binary, train binary").toPandas()
    h = np.frombuffer(b"".join(got.words), np.uint64)
    order = np.argsort(h)
    return h[order], np.frombuffer(b"".join(got.train), np.int64)[order]


def kinds(ranks: str) -> np.ndarray:
    """For each id whether it begins a word (1) and is not ASCII (2); 4 for the end of a text."""
    import base64

    with open(ranks, "rb") as f:
        found = {int(n): base64.b64decode(token) for token, n in map(bytes.split, f)}
    return np.array([found[i].startswith(b" ") + 2 * (not found[i].isascii()) for i in range(len(found))] + [4])


def encoded(rows: DataFrame, ranks: str, head: tuple[np.ndarray, np.ndarray], denominator: int) -> DataFrame:
    """rows (row, id, held, text). With ids (packed), the number of words, the base score's part of frequent words, how many of them are known, and the hashes of the others."""
    shared = rows.sparkSession.sparkContext.broadcast(head)  # HEAD pairs of numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (top, n) = encoder(ranks), shared.value
        logs = np.append(np.log10((n + 1) / denominator), 0.0)
        known = np.append(n > 0, False)
        leads = np.array([enc.decode_single_token_bytes(k).startswith(b" ") for k in range(enc.n_vocab)])

        def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """The subwords of words, one behind the other, and how many each has. They are encoded at once: only the first of a word begins with a space."""
            ids = enc.encode_to_numpy(b"".join(b" " + w for w in words).decode("utf-8", "replace"), disallowed_special=()).astype(np.uint16)
            begins = np.flatnonzero(leads[ids])
            if len(begins) == len(words):
                return ids, np.diff(np.append(begins, len(ids)))
            each = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            return np.array([k for own in each for k in own], np.uint16), np.array([len(own) for own in each], np.int64)

        for batch in (part for whole in batches for part in pieces(whole, 3, SLICE)):
            # each different word of the slice is looked up and encoded once
            words, which, counts = words_of(batch.column(3))
            distinct = word_hashes(words)
            order = np.argsort(distinct)  # near ones are looked up one after the other
            at = np.empty(len(order), np.int64)
            at[order] = np.searchsorted(top, distinct[order])
            if len(top):
                at = np.where(top[np.minimum(at, len(top) - 1)] == distinct, at, len(top))
            pool, size = subwords(words)
            begin, sizes = np.cumsum(size) - size, size[which]
            ids = pool[np.arange(sizes.sum()) + np.repeat(begin[which] - (np.cumsum(sizes) - sizes), sizes)]
            doc, docs = np.repeat(np.arange(len(counts)), counts), len(counts)
            rare = (at == len(top))[which]
            id_ends, rare_ends = (np.concatenate(([0], np.cumsum(np.bincount(doc, x, docs).astype(np.int64)))).tolist() for x in (sizes, rare))
            rest = distinct[which[rare]]
            packs = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x, ends in ((ids, id_ends), (rest, rare_ends))]
            base, seen = (np.bincount(doc, x[at][which], docs) for x in (logs, known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packs[0], pa.binary()), pa.array(counts), pa.array(base), pa.array(seen.astype(np.int64)), pa.array(packs[1], pa.binary())], ["row", "id", "held", "ids", "n", "base", "known", "rest"])

    kind = rows.schema["id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"row long, id {kind}, held boolean, ids binary, n long, base double, known long, rest binary"))


def rare_scores(texts: DataFrame, words: DataFrame, shards: int, denominator: int) -> DataFrame:
    """(row, base, known): what the words that are not frequent add, found in their shards."""
    bounds = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, rest = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            h = np.frombuffer(b"".join(rest), np.uint64)
            owner = np.repeat(rows, [len(b) // 8 for b in rest])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
            parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([owner[a:b].tobytes() for _, a, b in parts], pa.binary())], ["shard", "h", "owner"])

    def look_up(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"row": [], "base": [], "known": []})
        words_ = np.frombuffer(b"".join(table.words), np.uint64)
        n = np.append(np.frombuffer(b"".join(table.train), np.int64), 0)
        h, owner = (np.concatenate([np.frombuffer(b, t) for b in asked[c]]) for c, t in (("h", np.uint64), ("owner", np.int64)))
        at = np.searchsorted(words_, h)
        if len(words_):
            at = np.where(words_[np.minimum(at, len(words_) - 1)] == h, at, len(words_))
        rows, mine = np.unique(owner, return_inverse=True)
        return pd.DataFrame({"row": rows, "base": np.bincount(mine, np.log10((n[at] + 1) / denominator), len(rows)), "known": np.bincount(mine, n[at] > 0, len(rows)).astype(np.int64)})

    dealt = texts.select("row", "rest").mapInArrow(deal, "shard long, h binary, owner binary")
    found = dealt.groupBy("shard").cogroup(words.select("shard", "words", "train").groupBy("shard")).applyInPandas(look_up, "row long, base double, known long")
    return found.groupBy("row").agg(F.sum("base").alias("rare_base"), F.sum("known").alias("rare_known"))


def subword_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, the end of a text as id size - 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16)
            n += np.bincount(ids, minlength=size)
            n[size - 1] += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])

    got = texts.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # size rows at most
    out = np.zeros(size, np.int64)
    out[got.id.to_numpy(int)] = got.n
    return out


def neighbours(texts: DataFrame, out: Outputs, parts: int = FEWEST_PARTS) -> tuple[np.ndarray, np.ndarray]:
    """How often each class stands behind each symbol, and each symbol behind each class; the last rows are for the start of a text. As many numbers as the vocabulary and the classes give go to the driver."""
    size, classes = len(out.classes), len(out.shares)
    first, total = (size + 1) * classes, (size + 1) * classes + (classes + 1) * size
    bounds = np.arange(parts + 1) * total // parts
    group, cls = np.append(out.classes, classes), out.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total, np.int64)
        for batch in (part for whole in batches for part in pieces(whole, 0)):
            packs = batch.column(0).to_pylist()
            ends = np.cumsum([len(b) // 2 + 1 for b in packs])
            y = np.full(ends[-1], size - 1)  # the end of each text
            inner = np.ones(len(y), bool)
            inner[ends - 1] = False
            y[inner] = np.frombuffer(b"".join(packs), np.uint16)
            x = np.append(size, y[:-1])
            x[ends[:-1]] = size
            n[:first] += np.bincount(x * classes + cls[y], minlength=first)
            n[first:] += np.bincount(group[x] * size + y, minlength=total - first)
        for k in range(parts):
            at = np.flatnonzero(n[bounds[k] : bounds[k + 1]])
            if len(at):
                yield pa.RecordBatch.from_pydict({"part": [k], "at": [at.tobytes()], "n": [n[bounds[k] + at].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(k, np.zeros(bounds[k + 1] - bounds[k], np.int64))[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
        for k, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"part": [k], "at": [at.tobytes()], "n": [n[at].tobytes()]})

    schema = "part long, at binary, n binary"
    got = texts.select("ids").mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).toPandas()
    n = np.zeros(total, np.int64)
    for k, at, own in zip(got.part, got["at"], got.n, strict=True):
        n[bounds[k] + np.frombuffer(at, np.int64)] = np.frombuffer(own, np.int64)
    return n[:first].reshape(size + 1, classes), n[first:].reshape(classes + 1, size)


def windows(texts: Iterator[tuple[int, np.ndarray]], n: int, round_: int, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (before, targets, real) of the training windows of (number, symbols) texts whose turn it is; n stands before the first symbol."""
    held, count = [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(parts) for parts in zip(*held, strict=True)]

    for number, symbols in texts:
        first, blocks = (round_ - number) % SHARE, -(-len(symbols) // span)
        if first >= blocks:
            continue
        shifted = np.zeros(blocks * span + 1, np.int64)
        shifted[0], shifted[1 : len(symbols) + 1] = n, symbols
        x, y = (m.reshape(-1, span)[first::SHARE] for m in (shifted[:-1], shifted[1:]))
        held.append([x, y, np.arange(first, blocks, SHARE)[:, None] * span + np.arange(span) < len(symbols)])
        count += len(held[-1][0])
        if count >= BATCH:
            whole = joined()
            for k in range(0, count - BATCH + 1, BATCH):
                yield tuple(m[k : k + BATCH] for m in whole)
            count %= BATCH
            held = [[m[len(m) - count :] for m in whole]]
    if count:
        yield tuple(joined())


SCHEMA = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("x", pa.binary())])


def summed(rows: DataFrame, parts: int) -> DataFrame:
    """rows (part, shard, at, n, x): numbers of parameter rows, in order, how often each was seen, and the rows times that, packed. (part, at, n, x) with one row a part, the sums, which are taken in the order of shards."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, _, packed, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(packed, np.int64) // parts
                counts, sums = found.get(part, (np.zeros(0, np.int64), np.zeros((0, BRANCH))))
                if len(at) and at[-1] >= len(counts):
                    more = int(at[-1]) + 1 - len(counts)
                    counts, sums = np.append(counts, np.zeros(more, np.int64)), np.concatenate((sums, np.zeros((more, BRANCH))))
                counts[at] += np.frombuffer(n, np.int64)
                sums[at] += np.frombuffer(x, np.float32).reshape(-1, BRANCH)
                found[part] = counts, sums
        for part, (counts, sums) in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": [part], "shard": [None], "at": [(at * parts + part).tobytes()], "n": [counts[at].tobytes()], "x": [sums[at].astype(np.float32).tobytes()]}, SCHEMA)

    return rows.repartition(parts, "part").sortWithinPartitions("part", "shard").mapInArrow(add, "part long, shard long, at binary, n binary, x binary")


def dealt(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, ids): texts dealt to shards by a hash of id and ids, in the order of that hash. A shard is in one file, whose rows a task reads in order."""
    files = max(min(shards, FILES), -(-shards // FILE_SHARDS))
    at = F.xxhash64(*[c for c in ("id", "ids") if c in texts.columns])
    rows = texts.select(F.pmod(at, F.lit(shards)).alias("shard"), at.alias("at"), "ids")
    return staged(rows.repartitionById(files, F.pmod("shard", F.lit(files)).cast("int")).sortWithinPartitions("shard", "at").select("shard", "ids"))


def fit(texts: DataFrame, out: Outputs, parts: int = FEWEST_PARTS, shards: int = 1) -> Attention:
    """The model, trained on texts (ids): shards train apart and are averaged, an embedding or a decision by how often each has seen it. As many numbers as the model has go to the driver.

    Neither the partitions of texts nor the order of their rows matter. Rows
    that agree in id and text share a shard, which goes through its task as a
    stream.
    """
    size = len(out.classes)
    model = Attention(out, VIEW)
    context = texts.sparkSession.sparkContext
    outs = context.broadcast(out)  # some numbers for each subword of the vocabulary
    rows = dealt(texts, shards)
    for k in range(ROUNDS):
        now = context.broadcast(model.table())

        def learn(batches: Iterator[pa.RecordBatch], now=now, k: int = k) -> Iterator[pa.RecordBatch]:
            read_ = (row for whole in batches for batch in pieces(whole, 1) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for shard, members in itertools.groupby(read_, lambda row: row[0]):
                own = Attention(outs.value, VIEW).load(now.value)
                numbered = ((zlib.crc32(b), np.append(np.frombuffer(b, np.uint16), size - 1).astype(np.int64)) for _, b in members)
                before, decided = np.zeros(size + 1, np.int64), np.zeros(len(own.p["U"]), np.int64)
                seen = train(own, windows(numbered, size, k, VIEW), before=before, decided=decided)
                if not seen:
                    continue
                table = own.table()
                n = np.concatenate((np.repeat(before, own.p["E"].shape[1] // BRANCH), decided))
                n = np.append(n, np.full(len(table) - len(n), seen))
                for part in range(parts):
                    mine = np.arange(part, len(n), parts)
                    mine = mine[n[mine] > 0]
                    if len(mine):
                        yield pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "at": [mine.tobytes()], "n": [n[mine].tobytes()], "x": [(table[mine] * n[mine, None]).astype(np.float32).tobytes()]}, SCHEMA)

        got = summed(rows.mapInArrow(learn, "part long, shard long, at binary, n binary, x binary"), parts).toPandas()
        if len(got):
            at, n = (np.frombuffer(b"".join(got[c]), np.int64) for c in ("at", "n"))
            table = model.table()
            table[at] = np.frombuffer(b"".join(got.x), np.float32).reshape(-1, BRANCH) / n[:, None]
            model.load(table)
    return model


def model_scores(texts: DataFrame, model: Attention) -> DataFrame:
    """texts without ids and rest, with score, the log10 probability of the text and its end."""
    size = len(model.out.classes)
    keep = [c for c in texts.columns if c not in ("ids", "rest")]
    shared = texts.sparkSession.sparkContext.broadcast((model.out, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table = shared.value
        score = Attention(out, VIEW).load(table).scorer()
        for batch in (part for whole in batches for part in pieces(whole, len(keep), 1_000_000)):
            each = [np.append(np.frombuffer(b, np.uint16), size - 1).astype(np.int64) for b in batch.column(len(keep)).to_pylist()]
            lengths = np.array([len(x) for x in each])
            logs = score(np.concatenate(each), lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.add.reduceat(logs, np.cumsum(lengths) - lengths) / np.log(10))], [*keep, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return texts.select(*keep, "ids").mapInArrow(run, f"{types}, score double")


def score_texts(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; it learns from rows where held is false.

    Tokens are words and one end a text; null texts are empty and have only
    that. Null ids and repeated rows are scored like others, and learned from
    as often as they occur. Texts of any length are learned from and scored
    whole. Scores are the same however rows are spread over partitions. Where
    there is nothing to learn from, counts are 0 and the model stays as it
    began. Other columns are not returned, whatever their names;
    empty input gives empty output.
    """
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), held.alias("held"), F.col(text).alias("text"))
    total = docs.count()
    shards, parts = max(FEWEST_SHARDS, -(-total // SHARD_DOCS)), max(FEWEST_PARTS, -(-total // PART_DOCS))
    words = word_shards(rows, shards)
    sums = words.agg(F.sum("n_train"), F.sum("n_all"), F.sum("v")).first()
    n_words, n_all, v = (int(x or 0) for x in sums)
    ends = rows.filter(~F.col("held")).count()
    n, v = n_words + ends, v + (ends > 0)
    denominator = n + v + 1
    texts = encoded(rows, ranks, frequent(words, n_all), denominator)
    own = texts.filter(~F.col("held"))
    kind = kinds(ranks)
    counts = subword_counts(own, len(kind))
    out = factored(counts, kind, CLASSES)
    model = fit(own, conditioned(out, *neighbours(own, out)), parts, max(1, -(-int(counts.sum()) // TRAINED)))
    scored = model_scores(texts, model).join(rare_scores(texts, words, shards, denominator), "row", "left")
    zero = F.lit(0)
    end_base = float(np.log10((ends + 1) / denominator))
    return scored.select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", zero) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base).alias("base_score"), "score",
    )


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
