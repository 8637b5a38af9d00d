"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.llm import mixing, packing, residue, subjects, terms, transcripts
from plenaria.sources.tables import table

# --- problems 1 and 3: terms -------------------------------------------------

#: A term in SQL: NFC, lower case, straight apostrophe, single spaces.
_TERM = r"trim(regexp_replace(replace(nfc_normalize(lower(nfc_normalize(text))), '’', ''''), '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_USES = f"""WITH words AS (SELECT gid, {_TERM} AS term FROM ngrams WHERE text IS NOT NULL AND {_TERM} <> ''),
once AS (SELECT sid, gid, any_value(pid) AS pid, any_value(session_uid) AS session_uid, max(uses) AS uses FROM speech_ngrams GROUP BY sid, gid),
found AS (SELECT * FROM once JOIN words USING (gid)) """


def _term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(table(spark, sf_dir, "speech_ngrams"), table(spark, sf_dir, "ngrams", "gid", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return _term_frequency(spark, sf_dir).where("mark <> 'useful'").select("term", "mark")


def p1_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and speeches of every term, with its mark."""
    return _term_frequency(spark, sf_dir)


_P1 = (
    _USES
    + """, counted AS (SELECT term, sum(uses)::BIGINT AS uses, count(DISTINCT sid) AS speeches FROM found GROUP BY term),
every AS (SELECT count(DISTINCT sid) AS n FROM speech_ngrams),
marked AS (SELECT term, uses, speeches, CASE WHEN speeches <= 2 THEN 'rare' WHEN speeches > 0.1 * n THEN 'common' ELSE 'useful' END AS mark FROM counted, every) """
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most used terms of each person in each sitting."""
    return p3_top_terms(spark, sf_dir).drop("uses")


def p3_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like p3_found, with the number of uses."""
    return terms.top_terms(table(spark, sf_dir, "speech_ngrams"), table(spark, sf_dir, "ngrams", "gid", "text"))


_P3 = (
    _USES
    + """, summed AS (SELECT pid, session_uid, term, sum(uses)::BIGINT AS uses FROM found WHERE pid IS NOT NULL AND session_uid IS NOT NULL GROUP BY ALL),
ranked AS (SELECT pid, session_uid, row_number() OVER (PARTITION BY pid, session_uid ORDER BY uses DESC, term)::INTEGER AS rank_no, term, uses FROM summed) """
)

# --- problem 2: transcripts --------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every sitting, with the one person who speaks."""
    return transcripts.turns(table(spark, sf_dir, "transcript_lines"), table(spark, sf_dir, "politicians", "acteur_id", "full_name"), text=False)


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the clean text of each turn."""
    return transcripts.turns(table(spark, sf_dir, "transcript_lines"), table(spark, sf_dir, "politicians", "acteur_id", "full_name"))


# --- problem 4: subjects -----------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each speech deals with."""
    return p4_subjects(spark, sf_dir).select("sid", "domain_id")


def p4_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each subject's share of the speech, and whether content or a title names it."""
    said = table(spark, sf_dir, "speeches", "sid", "content", "dossier_title", "debate_title", "loaded_at")
    return subjects.subjects(said, table(spark, sf_dir, "domains"), table(spark, sf_dir, "topic_labels"))


# --- problems 7 and 8: containers and mixtures -------------------------------

CAPACITY = 2048


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in containers of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), CAPACITY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each container is."""
    fill = F.sum("units")
    return p7_pack(spark, sf_dir).groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), fill.alias("tokens"), (fill / CAPACITY).alias("fill"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of documents that make up the mixture."""
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    return mixing.shares(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "source_targets"))


# --- problem 9: residue ------------------------------------------------------


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue, filler, an error page or a script notice."""
    return p9_residue(spark, sf_dir).select("doc_id").distinct()


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the kinds of residue, and whether the document's own label is trusted."""
    return residue.residue(table(spark, sf_dir, "documents", "doc_id", "text"))


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "p1_found": (p1_found, _P1 + "SELECT term, mark FROM marked WHERE mark <> 'useful'"),
    "p1_frequency": (p1_frequency, _P1 + "SELECT * FROM marked"),
    "p2_found": (p2_found, None),
    "p2_turns": (p2_turns, None),
    "p3_found": (p3_found, _P3 + "SELECT pid, session_uid, rank_no, term FROM ranked WHERE rank_no <= 5"),
    "p4_found": (p4_found, None),
    "p4_subjects": (p4_subjects, None),
    "p7_pack": (p7_pack, None),
    "p7_containers": (p7_containers, None),
    "p8_mixture": (p8_mixture, None),
    "p8_shares": (p8_shares, None),
    "p9_found": (p9_found, None),
    "p9_residue": (p9_residue, None),
    "p3_top_terms": (p3_top_terms, _P3 + "SELECT * FROM ranked WHERE rank_no <= 5"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
