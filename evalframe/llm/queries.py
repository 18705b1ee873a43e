"""The registered queries ``opN_<name>`` of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import (
    crf_langid, fraction_sketch, importance_resampling, mil_quality, multi_index, packing, piece_bpe, simhash_covering, spelling_variants,
    template_extract, token_files, token_rollups, toxicity_grammar,
)
from evalframe.llm.common import prepare, read_table, saved
from evalframe.session import scratch_dir

# Where the public tokenizer files are found; replace to use others.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR is not None:
        return f"{TOKENIZER_DIR.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded again."""
    return piece_bpe.encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return multi_index.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return template_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_fraction_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document."""
    return fraction_sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 4 or fewer differing bits."""
    return simhash_covering.components(read_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as token-id files and read back."""
    path = scratch_dir(spark, "token-files")
    token_files.write(read_table(spark, sf_dir, "documents"), path, token_files.Tokens(tokenizer_path("byte_bpe_50k.json")))
    return token_files.read(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, one label fold in five held out."""
    return toxicity_grammar.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 5)


# Words between ASCII white space; runs of letters.
WORD, LETTERS = r"[^\x20\x09-\x0D]+", r"\p{L}+"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after three batches:
    all documents inserted, with their word counts for both versions; the
    counts of ``letters/1`` revised to runs of letters; documents labelled
    toxic deleted.  The second batch is committed twice, and the first two are
    folded into a base before the last."""
    counts = lambda pattern: F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern), F.lit(0))).cast("long")
    docs = saved(read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", counts(WORD).alias("words"), counts(LETTERS).alias("letters")), "token-counts")
    versions = F.explode(F.array(F.struct(F.lit("words/1").alias("tokenizer"), F.col("words").alias("old"), F.col("words").alias("new")),
                                 F.struct(F.lit("letters/1").alias("tokenizer"), F.col("words").alias("old"), F.col("letters").alias("new"))))
    rows = docs.select("doc_id", "source", "lang", versions.alias("v")).select("doc_id", "source", "lang", "v.*")
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    change = lambda kind, tokens, old=None: [F.lit(kind).alias("change"), *token_rollups.KEYS, F.col(tokens).alias("n_tokens"),
                                             (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens")]
    rollups = token_rollups.Rollups(spark, scratch_dir(spark, "rollups"))
    rollups.commit(1, rows.select(*change(token_rollups.INSERT, "old")))
    for _ in range(2):
        rollups.commit(2, rows.where("old <> new").select(*change(token_rollups.REVISE, "new", "old")))
    rollups.compact()
    rollups.commit(3, rows.join(toxic, "doc_id", "left_semi").select(*change(token_rollups.DELETE, "new")))
    return rollups.totals()


OP8_SQL = r"""
with counted as (
  select doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) as letters
  from documents
), versions as (
  select doc_id, source, lang, 'words/1' as tokenizer, words as n from counted
  union all
  select doc_id, source, lang, 'letters/1' as tokenizer, letters as n from counted
)
select source, lang, tokenizer, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens
from versions
where doc_id is null or doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)
group by source, lang, tokenizer
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, one fold in three held out."""
    return crf_langid.identified(read_table(spark, sf_dir, "documents"), 3, 1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word", 1, 4096)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, one label fold in five held out."""
    return mil_quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 5, 0.3)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's texts."""
    return importance_resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its form and root."""
    return spelling_variants.group(read_table(spark, sf_dir, "documents"), least=3, every=97)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_piece_bpe, op2_multi_index, op3_main_text, op4_fraction_sketch, op5_simhash, op6_token_files, op7_toxicity,
        op8_token_counts, op9_language, op10_packing, op11_quality, op12_resample,
        op13_spelling,
    )
}

ORACLES: dict[str, str] = {"op8_token_counts": OP8_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {k: prepared(f) for k, f in _QUERIES.items()}
