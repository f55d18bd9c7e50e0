"""The reference's operations as queries over the sample tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize, read_charsmap
from ..functions.pretokenize import WHITE_SPACE, metaspace_column, whitespace_metaspace_column
from ..operators import analytics, decode, encode, encoding, vocabulary
from ..sources import samples
from ..sources.model import META, Model
from ..sources.text import explode_lines
from . import oracle
from .template import bert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

UNIGRAM = samples.unigram()
METASPACE = samples.unigram(pre_tokenizer=samples.META_ONLY)
BYTES = samples.unigram(accented=False, byte_fallback=True)
ADDED = samples.unigram(added=("there", "the", ". ", "[CLS]x", "and"), pre_tokenizer=samples.META_ONLY)
MERGES = samples.bpe()
MAX_LENGTH = 32

BENCHMARK = "SELECT item_id AS k, text FROM benchmark"
DOCUMENTS = "SELECT doc_id AS k, text FROM documents"
TURNS = "SELECT conv_id * 1000 + turn AS k, text, conv_id, turn FROM conversations"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", "conv_id", "turn")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text", "lang", "source")


def _joined(array: Column, by: str = " ") -> Column:
    return F.array_join(array.cast("array<string>"), by)


def _md5(column: Column) -> Column:
    return F.md5(column.cast("binary"))


def _ids(df: DataFrame, model: Model, pieces: bool = True) -> DataFrame:
    return encode.encode(df, model, "text", "e", pieces=pieces)


# Vocabularies


def _spec_tables(spark: SparkSession, spec: dict) -> tuple[DataFrame, DataFrame]:
    vocab = spec["model"]["vocab"]
    rows = [(i, p, 0.0) for p, i in vocab.items()] if isinstance(vocab, dict) else [(i, p, s) for i, (p, s) in enumerate(vocab)]
    return spark.createDataFrame(rows, "id int, piece string, score double"), spark.createDataFrame([(t["id"], t["content"], t["special"]) for t in spec["added_tokens"]], "id int, content string, special boolean")


_BPE_SPEC = samples.bpe_spec()
_ADDED_SPEC = samples.unigram_spec(added=("there", "the", ". ", "[CLS]x", "and"))
_VOCAB = f"SELECT * FROM (VALUES {oracle.vocab_rows(UNIGRAM)}) AS t(piece, id, score, type)"
_NAMES = "CASE type WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'CONTROL' WHEN 4 THEN 'USER' WHEN 5 THEN 'UNUSED' WHEN 6 THEN 'BYTE' ELSE 'TYPE(' || type || ')' END"


@query(
    f"SELECT v.piece, CAST(coalesce(max({len(_BPE_SPEC['model']['merges'])} - m.rank), 0) AS DOUBLE) AS score FROM (VALUES {oracle.values([(p,) for p in _BPE_SPEC['model']['vocab']])}) AS v(piece) "
    f"LEFT JOIN (SELECT a || b AS piece, max(rank) AS rank FROM (VALUES {oracle.values([(k, a, b) for k, (a, b) in enumerate(_BPE_SPEC['model']['merges'])])}) AS m(rank, a, b) GROUP BY 1) m ON m.piece = v.piece GROUP BY 1"
)
def bpe_merge_scores(spark, sf_dir):
    """Scores that merges give: the last place of each merged string counts."""
    merges = _BPE_SPEC["model"]["merges"]
    ranked = spark.createDataFrame([(k, a + b) for k, (a, b) in enumerate(merges)], "rank int, piece string").groupBy("piece").agg(F.max("rank").alias("rank"))
    vocab, _ = _spec_tables(spark, _BPE_SPEC)
    return vocab.join(F.broadcast(ranked), "piece", "left").select("piece", F.coalesce(F.lit(len(merges)) - F.col("rank"), F.lit(0)).cast("double").alias("score"))


@query(
    f"SELECT CAST(v.id AS BIGINT) AS id, CAST(CASE WHEN a.content = '<unk>' THEN 2 WHEN a.special THEN 3 WHEN starts_with(a.content, '<unused') THEN 5 WHEN a.id IS NOT NULL THEN 4 WHEN regexp_full_match(v.piece, '<0x..>') THEN 6 ELSE 1 END AS BIGINT) AS type "
    f"FROM (VALUES {oracle.values([(i, p) for i, (p, _) in enumerate(_ADDED_SPEC['model']['vocab'])])}) AS v(id, piece) LEFT JOIN (VALUES {oracle.values([(t['id'], t['content'], t['special']) for t in _ADDED_SPEC['added_tokens']])}) AS a(id, content, special) ON a.id = v.id"
)
def vocab_classify(spark, sf_dir):
    vocab, added = _spec_tables(spark, _ADDED_SPEC)
    met = vocab.join(F.broadcast(added.withColumnRenamed("id", "aid")), F.col("id") == F.col("aid"), "left")
    kind = F.when(F.col("content") == "<unk>", 2).when(F.col("special"), 3).when(F.startswith("content", F.lit("<unused")), 5).when(F.col("aid").isNotNull(), 4).when(F.col("piece").rlike("^<0x..>$"), 6).otherwise(1)
    return met.select(F.col("id").cast("long"), kind.cast("long").alias("type"))


@query(f"SELECT CAST({UNIGRAM.unk_id} AS BIGINT) AS unk_id, min(id) FILTER (WHERE piece = '<bos>') AS bos_id, min(id) FILTER (WHERE piece = '<eos>') AS eos_id, min(id) FILTER (WHERE piece = '<pad>') AS pad_id FROM (SELECT piece, CAST(id AS BIGINT) AS id FROM ({_VOCAB}))")
def special_ids(spark, sf_dir):
    return UNIGRAM.config(spark).select(*(F.col(c).cast("long") for c in ("unk_id", "bos_id", "eos_id", "pad_id")))


@query(f"SELECT CAST(min(score) AS DOUBLE) AS min_score, CAST(max(score) AS DOUBLE) AS max_score FROM ({_VOCAB}) WHERE type = 1 AND score <> 0")
def vocab_score_bounds(spark, sf_dir):
    return UNIGRAM.vocab(spark).where("type = 1 and score <> 0").agg(F.min("score").cast("double").alias("min_score"), F.max("score").cast("double").alias("max_score"))


@query(f"SELECT count(*) AS vocab_size FROM ({_VOCAB})")
def vocab_size(spark, sf_dir):
    return UNIGRAM.vocab(spark).agg(F.count(F.lit(1)).alias("vocab_size"))


@query(f"SELECT o_orderkey AS k, o_custkey % 250 - 10 AS id, coalesce(piece, '') AS piece FROM orders LEFT JOIN ({_VOCAB}) v ON v.id = o_custkey % 250 - 10")
def id_to_piece(spark, sf_dir):
    ids = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 250 - 10).alias("id"))
    return vocabulary.id_to_piece(ids, UNIGRAM)


@query(f"SELECT o_orderkey AS k, coalesce(piece, '') AS piece, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(type, 0) AS BIGINT) AS type FROM orders LEFT JOIN ({_VOCAB}) v ON v.id = o_custkey % 250 - 10")
def get_piece(spark, sf_dir):
    ids = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 250 - 10).alias("id"))
    return vocabulary.get_piece(ids, UNIGRAM).select("k", "piece", F.col("score").cast("double").alias("score"), F.col("type").cast("long").alias("type"))


@query(f"SELECT w, coalesce(max(v.id), 0) AS id, count(*) AS n FROM (SELECT unnest({oracle.WORDS.format(text='text')}) AS w FROM documents) LEFT JOIN (SELECT piece, CAST(max(id) AS BIGINT) AS id FROM ({_VOCAB}) GROUP BY 1) v ON v.piece = w GROUP BY w")
def piece_to_id(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(whitespace_metaspace_column(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.piece_to_id(words, UNIGRAM, "w").select("w", F.col("id").cast("long").alias("id"), "n")


@query(f"SELECT CAST(id AS BIGINT) AS id, piece, CAST(score AS DOUBLE) AS score, {_NAMES} AS type_name FROM ({_VOCAB}) WHERE id < 10 OR id >= {len(UNIGRAM.pieces) - 10}")
def vocab_head_tail(spark, sf_dir):
    return vocabulary.head_tail(spark, UNIGRAM).select(F.col("id").cast("long"), "piece", F.col("score").cast("double").alias("score"), "type_name")


@query(f"SELECT {_NAMES} AS type_name, count(*) AS pieces, CASE WHEN any_value(type) = 3 THEN string_agg(piece, ' ' ORDER BY id) ELSE '' END AS listed FROM ({_VOCAB}) GROUP BY type")
def vocab_type_counts(spark, sf_dir):
    """Pieces by type, and the control pieces by name."""
    counts = vocabulary.type_counts(spark, UNIGRAM)
    listed = UNIGRAM.vocab(spark).where("type = 3").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"]), " ").alias("names")).withColumn("t", F.lit("CONTROL"))
    return counts.join(F.broadcast(listed), F.col("type_name") == F.col("t"), "left").select("type_name", "pieces", F.coalesce("names", F.lit("")).alias("listed"))


@query(f"SELECT CAST(id AS BIGINT) AS id, piece FROM ({_VOCAB}) WHERE contains(piece, 'e') ORDER BY id LIMIT 20")
def vocab_search(spark, sf_dir):
    return vocabulary.search(spark, UNIGRAM, "e").select(F.col("id").cast("long"), "piece")


@query("SELECT b AS byte, '<0x' || upper(printf('%02x', b)) || '>' AS piece, true AS is_byte FROM (SELECT unnest(range(256)) AS b)")
def byte_pieces(spark, sf_dir):
    """Byte pieces written and read again."""
    made = spark.range(256).select(F.col("id").alias("b"), F.concat(F.lit("<0x"), F.lpad(F.hex("id"), 2, "0"), F.lit(">")).alias("piece"))
    return made.select(F.conv(F.hex(F.unhex(F.substring("piece", 4, 2))), 16, 10).cast("long").alias("byte"), "piece", ((F.octet_length("piece") == 6) & F.col("piece").rlike("^<0x[0-9A-Fa-f]{2}>$")).alias("is_byte"))


_ADDED_VOCAB = f"SELECT * FROM (VALUES {oracle.vocab_rows(ADDED)}) AS t(piece, id, score, type)"


@query(
    f"SELECT piece, CAST(CAST(octet_length(encode(piece)) AS FLOAT) * (SELECT CAST(max(score) AS FLOAT) FROM ({_ADDED_VOCAB}) WHERE type = 1 AND score <> 0) - CAST(0.1 AS FLOAT) AS DOUBLE) AS score "
    f"FROM ({_ADDED_VOCAB}) WHERE type = 4"
)
def udef_score(spark, sf_dir):
    """What user-defined pieces score: their bytes times the greatest score, less 0.1, in float32."""
    own = ADDED.vocab(spark).where("type = 4")
    score = F.octet_length("piece").cast("float") * F.lit(float(ADDED.score_bounds[1])).cast("float") - F.lit(0.1).cast("float")
    return own.select("piece", score.cast("float").cast("double").alias("score"))


# Normalization and segments


@query(f"SELECT k, md5(CASE WHEN regexp_replace(text, '^ +', '') = '' THEN '' ELSE regexp_replace('{META}' || regexp_replace(regexp_replace(text, '^ +', ''), ' +', '{META}', 'g'), '(?:{META})+$', '') END) AS digest FROM ({DOCUMENTS})")
def normalize_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("k", _md5(normalize(F.col("text"), True, True, True)).alias("digest"))


# Ends of texts and lines that regular expressions and line readers easily get wrong.
_ENDS = ["", " ", "\n", " \n", "\n\n", " \n \n ", "\r", " \r\n", "\r\r\n", "\u2028", " \u2028", "\x85 ", "\n\r"]
_ENDS_SQL = "SELECT item_id * 100 + e.k AS k, text || e.ending || left(text, 9) || e.ending AS text FROM benchmark, (VALUES " + ", ".join("(" + str(k) + ", " + " || ".join(["''", *(f"chr({ord(c)})" for c in e)]) + ")" for k, e in enumerate(_ENDS)) + ") AS e(k, ending)"


def _with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("ending")) for k, e in enumerate(_ENDS)])).alias("e")
    made = _benchmark(spark, sf_dir).select("k", "text", ends)
    return made.select((F.col("k") * 100 + F.col("e.k")).alias("k"), F.concat("text", "e.ending", F.left("text", F.lit(9)), "e.ending").alias("text"))


@query(f"SELECT k, CASE WHEN regexp_replace(text, '^ +', '') = '' THEN '' ELSE regexp_replace('{META}' || regexp_replace(regexp_replace(text, '^ +', ''), ' +', '{META}', 'g'), '(?:{META})+$', '') END AS normalized FROM ({_ENDS_SQL})")
def normalize_ends(spark, sf_dir):
    """Normalization of texts with all kinds of ends."""
    return _with_ends(spark, sf_dir).select("k", normalize(F.col("text"), True, True, True).alias("normalized"))


@query(f"SELECT k, CAST(pos - 1 AS BIGINT) AS line_no, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS line FROM (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT k, CASE WHEN right(text, 1) = chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM ({_ENDS_SQL})))")
def line_ends(spark, sf_dir):
    """Texts with all kinds of ends, line by line."""
    return explode_lines(_with_ends(spark, sf_dir)).select("k", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"SELECT k, CAST(len(s) AS BIGINT) AS segments, md5(array_to_string(s, '|')) AS digest FROM (SELECT k, {oracle.METASPACE.format(text='text')} AS s FROM ({DOCUMENTS}))")
def metaspace_segments(spark, sf_dir):
    s = metaspace_column(F.col("text"))
    return _documents(spark, sf_dir).select("k", F.size(s).cast("long").alias("segments"), _md5(F.array_join(s, "|")).alias("digest"))


@query(f"SELECT k, CAST(len(s) AS BIGINT) AS segments, md5(array_to_string(s, '|')) AS digest FROM (SELECT k, {oracle.WORDS.format(text='text')} AS s FROM ({DOCUMENTS}))")
def ws_split_segments(spark, sf_dir):
    s = whitespace_metaspace_column(F.col("text"))
    return _documents(spark, sf_dir).select("k", F.size(s).cast("long").alias("segments"), _md5(F.array_join(s, "|")).alias("digest"))


_PARTS = "regexp_extract_all(text, '\\[CLS\\]x|there|and|the|\\. ')"


@query(f"SELECT k, CAST(len({_PARTS}) AS BIGINT) AS matches, array_to_string({_PARTS}, '|') AS matched FROM ({DOCUMENTS}) WHERE len({_PARTS}) > 0")
def added_token_split(spark, sf_dir):
    """Added tokens found in raw text, the longest at each place."""
    from ..functions.pretokenize import added_segments_column

    found = F.transform(F.filter(added_segments_column(F.col("text"), ADDED), lambda s: s["added_id"].isNotNull()), lambda s: s["segment"])
    return _documents(spark, sf_dir).select("k", F.size(found).cast("long").alias("matches"), F.array_join(found, "|").alias("matched")).where("matches > 0")


# A character map from accented letters to plain ones, of line ends to spaces, and of a ligature-like pair.
_PLAIN = dict(zip("äöüéèêçñíóáúàâîôûÄÖÜ", "aoueeecnioauaaiouAOU")) | {"ß": "ss", "\n": " "}
_MAPPED = replace(UNIGRAM, charsmap=samples.charsmap(_PLAIN), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
_MAPPED_SQL = "translate(replace(replace(text, 'ß', 'ss'), chr(10), ' '), 'äöüéèêçñíóáúàâîôûÄÖÜ', 'aoueeecnioauaaiouAOU')"


@query(f"SELECT * FROM (VALUES {oracle.values(list(_PLAIN.items()))}) AS t(source, replacement)")
def charsmap_rows(spark, sf_dir):
    """A model's character map as a table."""
    return spark.createDataFrame([(k.decode(), v) for k, v in read_charsmap(_MAPPED.charsmap).items()], "source string, replacement string")


@query(f"SELECT k, md5(CASE WHEN regexp_replace(t, '^ +', '') = '' THEN '' ELSE regexp_replace('{META}' || regexp_replace(regexp_replace(t, '^ +', ''), ' +', '{META}', 'g'), '(?:{META})+$', '') END) AS digest FROM (SELECT k, {_MAPPED_SQL} AS t FROM ({DOCUMENTS}))")
def charsmap(spark, sf_dir):
    """Normalization by a character map."""
    return encode.normalized(_documents(spark, sf_dir), _MAPPED).select("k", _md5(F.col("normalized")).alias("digest"))


# Encoding


def _digest_rows(df: DataFrame) -> DataFrame:
    return df.select("k", F.size("e.ids").cast("long").alias("n_tokens"), _md5(_joined(F.col("e.ids"))).alias("digest"))


_DIGEST = "SELECT k, coalesce(count(id), 0) AS n_tokens, md5(coalesce(string_agg(id, ' ' ORDER BY pos), '')) AS digest FROM src LEFT JOIN tok USING (k) GROUP BY k"


@query(oracle.encoded(UNIGRAM, DOCUMENTS, _DIGEST))
def encode_ids(spark, sf_dir):
    return _digest_rows(_ids(_documents(spark, sf_dir), UNIGRAM, pieces=False))


@query(oracle.encoded(METASPACE, "SELECT k, text FROM (" + TURNS + ")", "SELECT k, string_agg(piece, ' ' ORDER BY pos) AS pieces FROM tok GROUP BY k", oracle.METASPACE))
def encode_pieces(spark, sf_dir):
    # A filter on the pieces would have each text encoded twice; every other text has one.
    return _ids(_turns(spark, sf_dir).where("text <> ''"), METASPACE).select("k", _joined(F.col("e.pieces")).alias("pieces"))


@query(oracle.encoded(UNIGRAM, TURNS, "SELECT conv_id, string_agg(ids, '|' ORDER BY turn) AS ids FROM (SELECT k, conv_id, turn, coalesce(string_agg(id, ' ' ORDER BY pos), '') AS ids FROM src LEFT JOIN tok USING (k) GROUP BY ALL) GROUP BY conv_id"))
def encode_batch(spark, sf_dir):
    """Each conversation's turns as one batch."""
    batches = _turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return encode.encode_batches(batches, UNIGRAM, "texts", "ids").select("conv_id", F.array_join(F.transform("ids", lambda x: F.array_join(x.cast("array<string>"), " ")), "|").alias("ids"))


@query(oracle.encoded(UNIGRAM, BENCHMARK, "SELECT k, pos, id, piece FROM tok"))
def unigram_tokens(spark, sf_dir):
    return encode.tokens(_benchmark(spark, sf_dir), UNIGRAM).select("k", F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), "piece")


@query(oracle.encoded(MERGES, DOCUMENTS, _DIGEST))
def bpe_tokens(spark, sf_dir):
    return _digest_rows(_ids(_documents(spark, sf_dir), MERGES, pieces=False))


_UNUSED = replace(MERGES, types=np.where([p in ("the", "ing", "sch") for p in MERGES.pieces], 5, MERGES.types))


@query(oracle.encoded(_UNUSED, DOCUMENTS, _DIGEST))
def bpe_unused(spark, sf_dir):
    """Results that are marked unused are taken apart again."""
    return _digest_rows(_ids(_documents(spark, sf_dir), _UNUSED, pieces=False))


@query(oracle.encoded(BYTES, DOCUMENTS, _DIGEST))
def byte_fallback(spark, sf_dir):
    return _digest_rows(_ids(_documents(spark, sf_dir), BYTES, pieces=False))


_FEW = samples.unigram(accented=False)


@query(oracle.encoded(_FEW, DOCUMENTS, "SELECT k, count(*) FILTER (WHERE id = 0) AS unknown, md5(string_agg(piece, ' ' ORDER BY pos)) AS digest FROM tok GROUP BY k"))
def merge_unk(spark, sf_dir):
    """Runs of unknown pieces as one, by a model that lacks accented letters."""
    # Texts with a word; a filter on the ids would have each text encoded twice.
    made = _ids(_documents(spark, sf_dir).where(F.col("text").rlike(f"[^{WHITE_SPACE}]")), _FEW)
    return made.select("k", F.size(F.filter("e.ids", lambda i: i == 0)).cast("long").alias("unknown"), _md5(_joined(F.col("e.pieces"))).alias("digest"))


_SPLIT = "string_split(regexp_replace(text, '(\\[CLS\\]x|there|and|the|\\. )', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
_ADDED_PARTS = f"parts AS (SELECT k, generate_subscripts(ps, 1) AS part, unnest(ps) AS text FROM (SELECT k, {_SPLIT} AS ps FROM src))"


_ADDED_SEGMENTS = f"seg AS (SELECT k, part * 1000000 + generate_subscripts(s, 1) AS sp, unnest(s) AS w FROM (SELECT k, part, {oracle.METASPACE.format(text='text')} AS s FROM parts WHERE part % 2 = 1 AND text <> ''))"


@query(
    f"WITH src AS ({DOCUMENTS}),\n{_ADDED_PARTS},\n{_ADDED_SEGMENTS}\n"
    "SELECT k, count(*) AS segments, count(*) FILTER (WHERE added) AS added, md5(string_agg(w, '|' ORDER BY sp)) AS digest "
    "FROM (SELECT k, sp, w, false AS added FROM seg UNION ALL SELECT k, part * 1000000, text, true FROM parts WHERE part % 2 = 0) GROUP BY k"
)
def segments(spark, sf_dir):
    """Added tokens and pre-tokenized segments of each text, in order."""
    # Texts are shuffled rather than their segments; a key that has several texts has the segments of all, by place.
    texts = _documents(spark, sf_dir).where("text <> ''").select("k", "text").repartition("k").groupBy("k").agg(F.collect_list("text").alias("texts"))
    rows = texts.select("k", F.transform("texts", lambda t: encode.segments_column(t, ADDED)).alias("each"))
    placed = F.flatten(F.transform("each", lambda e: F.transform(e, lambda s, i: F.struct(i.alias("seg_pos"), s["segment"].alias("segment")))))
    by_place = F.when(F.size("each") > 1, F.transform(F.array_sort(placed), lambda x: x["segment"])).otherwise(F.get("each", F.lit(0))["segment"])
    added = F.aggregate("each", F.lit(0), lambda n, e: n + F.size(F.filter(e, lambda s: s["added_id"].isNotNull())))
    total = F.aggregate("each", F.lit(0), lambda n, e: n + F.size(e))
    return rows.select("k", total.cast("long").alias("segments"), added.cast("long").alias("added"), _md5(F.array_join(by_place, "|")).alias("digest"))


@query(
    f"WITH RECURSIVE src AS ({DOCUMENTS}),\n{_ADDED_PARTS},\n"
    f"{_ADDED_SEGMENTS},\n"
    f"words AS (SELECT DISTINCT w FROM seg),\n{oracle.unigram_ctes(ADDED)},\n"
    + oracle.token_ctes(ADDED).replace("FROM seg JOIN enc USING (w))", "FROM seg JOIN enc USING (w) UNION ALL SELECT k, part * 1000000, 1, v.id, p.text FROM parts p JOIN vocab v ON v.piece = p.text WHERE part % 2 = 0)")
    + f"\n{_DIGEST}"
)
def encode_added(spark, sf_dir):
    """Added tokens stand for themselves, the texts between them are encoded each on its own."""
    return _digest_rows(_ids(_documents(spark, sf_dir), ADDED, pieces=False))


# Decoding


_DECODED = f"CASE WHEN id = 0 THEN ' ⁇ ' ELSE replace(piece, '{META}', ' ') END"


@query(oracle.encoded(UNIGRAM, DOCUMENTS, f"SELECT k, md5(coalesce(string_agg({_DECODED}, '' ORDER BY pos), '')) AS digest FROM src LEFT JOIN tok USING (k) GROUP BY k"))
def decode_text(spark, sf_dir):
    """Decoding as one expression over the id array."""
    return decode.decode(_ids(_documents(spark, sf_dir), UNIGRAM, pieces=False).withColumn("ids", F.col("e.ids")), UNIGRAM).select("k", _md5(F.col("decoded")).alias("digest"))


@query(oracle.encoded(UNIGRAM, BENCHMARK, f"SELECT k, string_agg({_DECODED}, '' ORDER BY pos) AS text FROM tok GROUP BY k"))
def decode_tokens(spark, sf_dir):
    """Decoding by joining token rows to the vocabulary."""
    rows = encode.tokens(_benchmark(spark, sf_dir), UNIGRAM)
    return decode.decode_tokens(rows, UNIGRAM, "k").select("k", "text")


@query(f"SELECT k, md5(array_to_string(list_transform({oracle.WORDS.format(text='text')}, lambda w: replace(w, '{META}', ' ')), '')) AS digest, true AS same FROM ({DOCUMENTS})")
def roundtrip(spark, sf_dir):
    """With bytes to fall back to, decoding gives the words back."""
    made = _ids(_documents(spark, sf_dir), BYTES, pieces=False)
    text = decode.decode_column(F.col("e.ids"), BYTES)
    words = F.array_join(F.transform(whitespace_metaspace_column(F.col("text")), lambda w: F.replace(w, F.lit(META), F.lit(" "))), "")
    return made.select("k", _md5(text).alias("digest"), (text == words).alias("same"))


# Model inputs

_LISTS = "lists AS (SELECT k, list(id ORDER BY pos) AS ids, list(piece ORDER BY pos) AS toks FROM tok GROUP BY k)"


def _strings(enc: str = "encoding") -> list[Column]:
    return [_joined(F.col(f"{enc}.{f}")).alias(f) for f in encoding.FIELDS]


def _lists(final: str, model: Model = UNIGRAM, source: str = BENCHMARK) -> str:
    return oracle.encoded(model, source, f", {_LISTS}\n{final}")


def _fields(ids: str, toks: str, mask: str, types: str, special: str) -> str:
    return ", ".join(f"array_to_string({v}, ' ') AS {f}" for f, v in zip(encoding.FIELDS, (ids, toks, mask, types, special)))


def _again(value: str, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {value})"


@query(_lists(f"SELECT k, array_to_string(list_concat(list_concat([{UNIGRAM.bos_id}], ids), [{UNIGRAM.eos_id}]), ' ') AS ids FROM lists"))
def add_special(spark, sf_dir):
    return _ids(_benchmark(spark, sf_dir), UNIGRAM).select("k", _joined(encoding.add_special(F.col("e.ids"), UNIGRAM)).alias("ids"))


@query(_lists(f"SELECT k, {_fields('ids', 'toks', _again('1', 'len(ids)'), _again('0', 'len(ids)'), _again('0', 'len(ids)'))} FROM lists"))
def encoding_masks(spark, sf_dir):
    return encoding.Pipeline(UNIGRAM).encode(_benchmark(spark, sf_dir)).select("k", *_strings())


_BERT = bert(4, 5)
_T = "t AS (SELECT k, list_concat(list_concat([CAST(4 AS BIGINT)], ids), [CAST(5 AS BIGINT)]) AS ids, list_concat(list_concat(['[CLS]'], toks), ['[SEP]']) AS toks, list_concat(list_concat([1], list_transform(ids, lambda x: 0)), [1]) AS sp FROM lists)"


@query(_lists(f", {_T} SELECT k, {_fields('ids', 'toks', _again('1', 'len(ids)'), _again('0', 'len(ids)'), 'sp')} FROM t"))
def template_bert(spark, sf_dir):
    return encoding.Pipeline(UNIGRAM, template=_BERT).encode(_benchmark(spark, sf_dir)).select("k", *_strings())


@query(_lists(f"SELECT k, {_fields('ids[1:7]', 'toks[1:7]', _again('1', 'least(len(ids), 7)'), _again('0', 'least(len(ids), 7)'), _again('0', 'least(len(ids), 7)'))} FROM lists"))
def truncate(spark, sf_dir):
    return encoding.Pipeline(UNIGRAM).with_truncation(7).encode(_benchmark(spark, sf_dir)).select("k", *_strings())


def _padded(left: bool) -> str:
    n = "greatest(100 - len(ids), 0)"

    def both(a: str, fill: str) -> str:
        more = _again(fill, n)
        return f"list_concat({more}, {a})" if left else f"list_concat({a}, {more})"

    ones, zeros = _again("1", "len(ids)"), _again("0", "len(ids)")
    return _fields(both("ids", "CAST(3 AS BIGINT)"), both("toks", "'<pad>'"), both(ones, "0"), both(zeros, "0"), both(zeros, "0"))


@query(_lists(f"SELECT k, {_padded(False)} FROM lists"))
def pad_right(spark, sf_dir):
    return encoding.Pipeline(UNIGRAM).with_padding(encoding.FIXED, 100, 3, "<pad>").encode(_benchmark(spark, sf_dir)).select("k", *_strings())


@query(_lists(f"SELECT k, {_padded(True)} FROM lists"))
def pad_left(spark, sf_dir):
    return encoding.Pipeline(UNIGRAM).with_padding(encoding.FIXED, 100, 3, "<pad>", encoding.LEFT).encode(_benchmark(spark, sf_dir)).select("k", *_strings())


@query(oracle.encoded(UNIGRAM, TURNS, ", n AS (SELECT k, count(id) AS own FROM src LEFT JOIN tok USING (k) GROUP BY ALL) SELECT k, own AS attended, max(own) OVER () AS padded FROM n"))
def pad_longest_of_all(spark, sf_dir):
    """Turns padded to the longest of the table."""
    made = encoding.Pipeline(UNIGRAM).with_padding(encoding.LONGEST, pad_id=3).encode(_turns(spark, sf_dir))
    return made.select("k", F.aggregate("encoding.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), F.size("encoding.input_ids").cast("long").alias("padded"))


@query(_lists(f"SELECT k, {_fields('list_reverse(ids)', 'list_reverse(toks)', _again('1', 'len(ids)'), _again('7', 'len(ids)'), _again('0', 'len(ids)'))} FROM lists"))
def own_post_processor(spark, sf_dir):
    """A post-processor that a user writes as a function of the encoding."""

    def turned(enc: Column) -> Column:
        own = {"input_ids": F.reverse(enc["input_ids"]), "tokens": F.reverse(enc["tokens"]), "token_type_ids": F.transform(enc["token_type_ids"], lambda x: F.lit(7))}
        return F.struct(*[own.get(f, enc[f]).alias(f) for f in encoding.FIELDS])

    return encoding.Pipeline(UNIGRAM, template=turned).encode(_benchmark(spark, sf_dir)).select("k", *_strings())


@query(oracle.encoded(UNIGRAM, TURNS, ", n AS (SELECT k, conv_id, count(id) AS own FROM src LEFT JOIN tok USING (k) GROUP BY ALL) SELECT k, own AS attended, max(own) OVER (PARTITION BY conv_id) AS padded FROM n"))
def pad_longest(spark, sf_dir):
    """Turns padded to the longest of their conversation."""
    made = encoding.Pipeline(UNIGRAM).with_padding(encoding.LONGEST, pad_id=3).encode(_turns(spark, sf_dir), batch="conv_id")
    return made.select("k", F.aggregate("encoding.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), F.size("encoding.input_ids").cast("long").alias("padded"))


_CUT = "c AS (SELECT k, ids[1:{n}] AS ids, toks[1:{n}] AS toks, sp[1:{n}] AS sp FROM t)"


def _fixed(n: int, pad_id: int) -> str:
    more = f"{n} - len(ids)"
    return _fields(f"list_concat(ids, {_again(f'CAST({pad_id} AS BIGINT)', more)})", f"list_concat(toks, {_again(chr(39) * 2, more)})", f"list_concat({_again('1', 'len(ids)')}, {_again('0', more)})", _again("0", str(n)), f"list_concat(sp, {_again('0', more)})")


@query(_lists(f", {_T}, {_CUT.format(n=60)} SELECT k, {_fixed(60, 3)} FROM c"))
def encode_options(spark, sf_dir):
    """Template, then truncation, then padding."""
    made = encoding.Pipeline(UNIGRAM, template=_BERT, max_length=60).with_padding(encoding.FIXED, 60, 3).encode(_benchmark(spark, sf_dir))
    return made.select("k", *_strings())


def model_input_pipeline(model: Model, length: int = MAX_LENGTH) -> encoding.Pipeline:
    """Begin and end ids around a text, cut and filled to a length; the pad id is that of the piece <pad> if unset."""
    pad_id = model.pad_id if model.pad_id >= 0 else model.piece_to_id("<pad>")
    return encoding.Pipeline(model, template=bert(model.bos_id, model.eos_id), max_length=length).with_padding(encoding.FIXED, length, pad_id)


@query(
    oracle.encoded(
        UNIGRAM,
        TURNS,
        f", lists AS (SELECT k, list(id ORDER BY pos) FILTER (WHERE id IS NOT NULL) AS own FROM src LEFT JOIN tok USING (k) GROUP BY k), c AS (SELECT k, list_concat(list_concat([CAST(1 AS BIGINT)], coalesce(own, [])), [CAST(2 AS BIGINT)])[1:{MAX_LENGTH}] AS ids FROM lists) "
        f"SELECT k, array_to_string(list_concat(ids, {_again('CAST(3 AS BIGINT)', f'{MAX_LENGTH} - len(ids)')}), ' ') AS input_ids, CAST(len(ids) AS BIGINT) AS attended FROM c",
    )
)
def model_inputs(spark, sf_dir):
    made = model_input_pipeline(UNIGRAM).encode(_turns(spark, sf_dir))
    return made.select("k", _joined(F.col("encoding.input_ids")).alias("input_ids"), F.aggregate("encoding.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


# Statistics

_LINES = "SELECT doc_id * 10000 + pos AS k, line AS text FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS ls FROM documents WHERE text <> ''))"


@query(oracle.encoded(UNIGRAM, _LINES, "SELECT CAST(floor(k / 10000) AS BIGINT) AS doc_id, CAST(k % 10000 AS BIGINT) AS line_no, count(id) AS n_tokens, any_value(length(text)) AS chars FROM src LEFT JOIN tok USING (k) GROUP BY k"))
def line_token_stats(spark, sf_dir):
    """Tokens of each line of each document."""
    lines = explode_lines(_documents(spark, sf_dir).select(F.col("k").alias("doc_id"), "text"))
    return analytics.line_stats(lines, UNIGRAM).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_tokens", F.length("line").cast("long").alias("chars"))


@query(oracle.encoded(UNIGRAM, "SELECT doc_id AS k, text, lang, source FROM documents", "SELECT lang, source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT k, lang, source, count(id) AS n FROM src LEFT JOIN tok USING (k) GROUP BY ALL) GROUP BY ROLLUP (lang, source)"))
def corpus_token_stats(spark, sf_dir):
    """Tokens by language and source, with totals; an addition to what examples print."""
    stats = analytics.line_stats(_documents(spark, sf_dir), UNIGRAM, "text")
    return stats.rollup("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


@query(oracle.encoded(UNIGRAM, TURNS, ", n AS (SELECT k, conv_id, turn, count(id) AS own FROM src LEFT JOIN tok USING (k) GROUP BY ALL) SELECT conv_id, turn, own AS n_tokens, count(*) OVER w AS lines_so_far, CAST(sum(own) OVER w AS BIGINT) AS tokens_so_far FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"))
def running_token_stats(spark, sf_dir):
    stats = analytics.line_stats(_turns(spark, sf_dir), UNIGRAM, "text")
    return analytics.running_totals(stats, "conv_id", "turn").select("conv_id", "turn", "n_tokens", "lines_so_far", "tokens_so_far")


@query(oracle.encoded(UNIGRAM, TURNS, "SELECT count(DISTINCT k) AS texts, count(id) AS tokens FROM src LEFT JOIN tok USING (k)"))
def batch_total(spark, sf_dir):
    stats = analytics.line_stats(_turns(spark, sf_dir), UNIGRAM, "text")
    return analytics.totals(stats).select(F.col("lines").alias("texts"), "tokens")


@query(
    oracle.encoded(
        UNIGRAM,
        TURNS,
        ", s AS (SELECT k, conv_id, turn, coalesce(list(DISTINCT id) FILTER (WHERE id IS NOT NULL), []) AS ids FROM src LEFT JOIN tok USING (k) GROUP BY ALL), p AS (SELECT conv_id, turn, ids, lag(ids) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM s) "
        "SELECT conv_id, turn, CAST(len(list_intersect(ids, before)) AS BIGINT) AS shared_ids, CAST(len(list_distinct(list_concat(ids, before))) AS BIGINT) AS union_ids, len(list_intersect(ids, before)) / len(list_distinct(list_concat(ids, before))) AS jaccard FROM p WHERE before IS NOT NULL",
    )
)
def jaccard_pairs(spark, sf_dir):
    """How alike each turn's ids are to those of the turn before."""
    from pyspark.sql import Window

    made = _ids(_turns(spark, sf_dir), UNIGRAM, pieces=False).select("conv_id", "turn", F.col("e.ids").alias("ids"))
    pairs = made.withColumn("before", F.lag("ids").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return pairs.select("conv_id", "turn", *(c.alias(n) for n, c in analytics.jaccard(F.col("ids"), F.col("before")).items()))


@query(
    f"WITH a AS ({oracle.encoded(UNIGRAM, BENCHMARK, 'SELECT k, count(*) AS n FROM tok GROUP BY k')}), b AS ({oracle.encoded(MERGES, BENCHMARK, 'SELECT k, count(*) AS n FROM tok GROUP BY k')}) "
    "SELECT k, a.n AS tokens_first, b.n AS tokens_second, a.n - b.n AS difference, CASE WHEN a.n > b.n THEN 'second' WHEN a.n < b.n THEN 'first' ELSE 'same' END AS fewer FROM a JOIN b USING (k)"
)
def compare_models(spark, sf_dir):
    return analytics.compare(_benchmark(spark, sf_dir), UNIGRAM, MERGES).drop("text")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language of the whole corpus."""
    stats = analytics.line_stats(_documents(spark, sf_dir), UNIGRAM, "text")
    return analytics.totals(stats, "lang")
