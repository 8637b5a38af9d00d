"""Tables of the archive through every file format: written by the sinks, read again by the scans, and counted.

Each query writes a table whole into the checkpoint folder, reads it from there, and says what it read, so the SQL
on the table itself is the oracle of the round trip.
"""

from __future__ import annotations

import io
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.plans.base import ASIDES, SAID, asides, said, words_sql
from plenaria.session import scratch
from plenaria.sources import debates, files
from plenaria.sources.tables import table


def s4_json_lines(spark, sf_dir):
    """Asides as JSON lines: rows, keys and words by kind of record."""
    own, path = table(spark, sf_dir, "asides"), scratch(spark, "json-lines")
    files.write_json_lines(own, path)
    again = files.json_lines(spark, path, own.schema)
    return again.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("aside_id").alias("ids"), F.sum("words").alias("words"), F.sum(F.size(F.coalesce("group_codes", F.array().cast("array<string>")))).alias("groups"))


def s5_json_files(spark, sf_dir):
    """Subjects as JSON documents of their own with their expressions, read as variants: single values are lists of one."""
    path = scratch(spark, "json-files")
    one = F.when(F.size("keywords") == 1, F.to_json(F.struct("domain_id", F.col("keywords")[0].alias("keywords")))).otherwise(F.to_json(F.struct("domain_id", "keywords")))
    own = table(spark, sf_dir, "domains")
    own.select("domain_id", F.concat(F.lit('{"organe":'), one, F.lit("}")).alias("value")).repartition(4, "domain_id").write.partitionBy("domain_id").text(path)
    read = files.json_files(spark, f"{path}/*/*.txt", "organe")
    listed = files.as_list(F.col("value"), "$.keywords", "string")
    return read.select(files.text_or_object("value", "$.domain_id").alias("domain_id"), F.size(listed).alias("expressions"), F.array_join(listed, "|").alias("joined"))


def _zipped(df: DataFrame, path: str, name: str, text: str) -> None:
    """One archive for each partition, with a member for each row, in the folder ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = io.BytesIO(), 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for n, t in zip(batch[name], batch[text]):
                    archive.writestr(n, t)
                    held += 1
        if held:
            yield pd.DataFrame({"content": [out.getvalue()]})

    df.select(name, text).mapInPandas(run, "content binary").write.parquet(path + "-packed")
    packed = df.sparkSession.read.parquet(path + "-packed").withColumn("no", F.monotonically_increasing_id())
    jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    for r in packed.toLocalIterator():  # an archive at a time
        stream = system.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{r['no']}.zip"))
        stream.write(bytes(r["content"]))
        stream.close()


def s6_zip(spark, sf_dir):
    """Politicians as JSON members of ZIP archives: rows and names by group."""
    own, path = table(spark, sf_dir, "politicians"), scratch(spark, "zip")
    _zipped(own.select(F.concat("acteur_id", F.lit(".json")).alias("name"), F.to_json(F.struct("pid", "party", "full_name")).alias("t")).repartition(3), path, "name", "t")
    read = files.zip_members(spark, f"{path}/*.zip", ".json").select(F.from_json(F.decode("content", "UTF-8"), "pid bigint, party string, full_name string").alias("r"), "member")
    return read.groupBy(F.coalesce("r.party", F.lit("")).alias("party")).agg(F.count(F.lit(1)).alias("n"), F.sum("r.pid").alias("pids"), F.max("r.full_name").alias("last_name"), F.min("member").alias("first_member"))


def s7_text_lines(spark, sf_dir):
    """Quotes of asides as one text of each sitting, read back by line."""
    own, path = table(spark, sf_dir, "asides").where("quote <> '' and session_uid is not null"), scratch(spark, "texts")
    files.write_texts(own, path, "session_uid", ["aside_id", "quote"], "quote")
    read = files.text_lines(spark, f"{path}/*/*.txt")
    return read.groupBy(F.regexp_extract("path", "session_uid=([^/]+)", 1).alias("session_uid")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("signs"))


def s9_csv(spark, sf_dir):
    """Seats as CSV in both ways, and through Latin-1."""
    own = table(spark, sf_dir, "seats").select("acteur_id", "department", "department_name", "constituency_no")
    plain, excel = scratch(spark, "csv"), scratch(spark, "excel")
    columns = ["constituency_no", "department_name", "acteur_id", "department"]
    files.write_csv(own, plain, columns)
    files.write_csv(own, excel, columns, excel=True)
    kinds = "constituency_no int, department_name string, acteur_id string, department string"
    a = files.csv_table(spark, plain, kinds).withColumn("way", F.lit("plain"))
    b = files.csv_table(spark, excel, None, ";").toDF(*columns).withColumn("constituency_no", F.expr("try_cast(constituency_no as int)")).withColumn("way", F.lit("excel"))
    every = a.unionByName(b)
    return every.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.sum("constituency_no").alias("numbers"), F.countDistinct("acteur_id").alias("people"), F.countDistinct(F.when(F.col("department_name") != "", F.col("department_name"))).alias("departments"))


def _workbook(rows: list[tuple[str, str, int]]) -> bytes:
    """A workbook with one sheet: a shared string, a text within the cell, a number."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = sorted({r[0] for r in rows})
    at = {s: i for i, s in enumerate(shared)}
    cells = "".join(f'<row><c r="A{i}" t="s"><v>{at[a]}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(b)}</t></is></c><c r="C{i}"><v>{c}</v></c></row>' for i, (a, b, c) in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="T" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def _local(spark: SparkSession, name: str, content: bytes) -> str:
    """A small file in the checkpoint folder."""
    path, jvm = f"{scratch(spark, 'file')}/{name}", spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    stream.write(content)
    stream.close()
    return path


def s10_xlsx(spark, sf_dir):
    """The nations as a workbook."""
    rows = [(r["n_name"], f"région {r['n_regionkey']}", r["n_nationkey"]) for r in table(spark, sf_dir, "nation").collect()]  # a fixed list
    read = files.xlsx_sheet(spark, _local(spark, "b.xlsx", _workbook(rows)), "T")
    return read.select(F.col("cells")[0].alias("name"), F.col("cells")[1].alias("region"), F.col("cells")[2].cast("int").alias("key"))


def s11_sqlite(spark, sf_dir):
    """The source targets as a SQLite database."""
    rows = [tuple(r) for r in table(spark, sf_dir, "source_targets").select("source", "target_share", "max_repeats").collect()]  # a fixed list
    with tempfile.TemporaryDirectory() as folder:
        at = Path(folder) / "d.sqlite"
        with sqlite3.connect(at) as db:
            db.execute("create table t (source text, share real, cap int)")
            db.executemany("insert into t values (?, ?, ?)", rows)
        db.close()
        read = files.sqlite_table(spark, str(at), "select source, share, cap from t where cap > 0", "source string, share double, cap int").collect()
    return spark.createDataFrame(read, "source string, share double, cap int")


def write_transcripts(spark: SparkSession, sf_dir: str) -> str:
    """Speeches of each sitting as a debate transcript in XML, one point of the agenda each; the pattern of the files."""
    own = said(spark, sf_dir, "content").where("session_uid is not null")
    words = F.regexp_replace(F.array_join(F.coalesce("content", F.array().cast("array<string>")), " "), r"[^\p{L}]+", " ")
    plain = own.select("session_uid", "sid", F.trim(words).alias("t")).where("t <> ''")
    sid = F.col("sid").cast("string")
    point = F.concat(
        F.lit('<point nivpoint="1" id_syceron="'), sid, F.lit('"><texte>Point '), sid, F.lit('</texte></point><paragraphe code_grammaire="PAROLE_GENERIQUE" id_acteur="PA'), sid,
        F.lit('"><orateurs><orateur><nom>Orateur '), sid, F.lit("</nom></orateur></orateurs><texte>"), F.col("t"), F.lit("</texte></paragraphe>"),
    )
    sheets = plain.groupBy("session_uid").agg(F.array_join(F.collect_list(point), "").alias("points"))  # a file is one sitting
    head = F.concat(F.lit("<compteRendu><uid>"), F.col("session_uid"), F.lit("</uid><metadonnees><dateSeance>20240102150000000</dateSeance></metadonnees><contenu>"))
    path = scratch(spark, "xml")
    sheets.select(F.col("session_uid").alias("session"), F.concat(head, F.col("points"), F.lit("</contenu></compteRendu>")).alias("value")).write.partitionBy("session").text(path)
    return f"{path}/*/*.txt"


def s1_transcripts(spark, sf_dir):
    """Transcripts in XML, read by paragraphs and put together: speeches and characters by sitting."""
    read = debates.speeches(debates.paragraphs(spark, write_transcripts(spark, sf_dir)))
    return read.groupBy("session_uid").agg(F.count(F.lit(1)).alias("speeches"), F.sum(F.length("text")).alias("signs"), F.min("day").cast("string").alias("day"))


def _lettered(c):
    """Letters and single spaces only, so that XML carries them as they are."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]+", " "))


def write_debates(spark: SparkSession, sf_dir: str) -> str:
    """Sittings as debate transcripts with an agenda of two levels, paragraphs of speeches, and interruptions; the pattern of the files."""
    parts = F.filter(F.transform(F.coalesce("content", F.array().cast("array<string>")), _lettered), lambda p: p != "")
    own = said(spark, sf_dir, "content", "debate_title", "dossier_title", "section_code", "bill_number").where("session_uid is not null").select(
        "session_uid", "sid", parts.alias("parts"), _lettered(F.col("debate_title")).alias("first"), _lettered(F.col("dossier_title")).alias("second"),
        F.when(F.col("section_code") == "QST_GVT", "QG").otherwise(F.coalesce("section_code", F.lit(""))).alias("section"), F.coalesce("bill_number", F.lit("")).alias("bill"),
    )
    sid = F.col("sid").cast("string")

    def paragraph(code, acteur, label, text):
        return F.concat(F.lit('<paragraphe code_grammaire="'), F.lit(code), F.lit('" id_acteur="'), acteur, F.lit('"><orateurs><orateur><nom>'), label, F.lit("</nom></orateur></orateurs><texte>"), text, F.lit("</texte></paragraphe>"))

    speech = F.array_join(F.transform("parts", lambda p: paragraph("PAROLE_GENERIQUE", F.concat(F.lit("PA"), sid), F.concat(F.lit("Orateur "), sid), p)), "")
    head = F.concat(
        F.lit('<point nivpoint="1" code_grammaire="'), F.col("section"), F.lit('" id_syceron="'), sid, F.lit('" valeur="'), F.col("bill"), F.lit('"><texte>'), F.col("first"), F.lit('</texte></point><point nivpoint="2" code_grammaire="'), F.col("section"),
        F.lit('"><texte>'), F.col("second"), F.lit("</texte></point>"),
    )
    spoken = own.where(F.size("parts") > 0).groupBy("session_uid").agg(F.array_join(F.collect_list(F.concat(head, speech)), "").alias("spoken"))  # a file is one sitting
    quote = F.concat(F.lit("Bon "), _lettered(F.col("quote")))
    cut = asides(spark, sf_dir).where("record_type = 'interruption' and session_uid is not null and day is not null")
    heckled = cut.groupBy("session_uid").agg(F.array_join(F.collect_list(paragraph("INTERRUPTION_1", F.concat(F.lit("PA"), F.col("aside_id").cast("string")), F.concat(F.lit("M. "), F.coalesce(F.nullif(_lettered(F.col("speaker")), F.lit("")), F.lit("X"))), quote)), "").alias("heckled"))
    both = spoken.join(heckled, "session_uid", "full").fillna("", ["spoken", "heckled"])
    opened = F.concat(F.lit("<compteRendu><uid>"), F.col("session_uid"), F.lit("</uid><metadonnees><dateSeance>20240102150000000</dateSeance><numSeance>7</numSeance></metadonnees><contenu>"))
    path = scratch(spark, "debates")
    both.select(F.col("session_uid").alias("session"), F.concat(opened, F.col("spoken"), F.col("heckled"), F.lit("</contenu></compteRendu>")).alias("value")).write.partitionBy("session").text(path)
    return f"{path}/*/*.txt"


def s2_metadata(spark, sf_dir):
    """What heads each transcript: sitting, day, number; with its paragraphs and those of interruptions."""
    rows = debates.paragraphs(spark, write_debates(spark, sf_dir))
    return rows.groupBy("session_uid").agg(F.min("day").cast("string").alias("day"), F.min("sitting").alias("sitting"), F.sum((F.col("code") == "PAROLE_GENERIQUE").cast("int")).alias("paragraphs"), F.sum((F.col("code") == "INTERRUPTION_1").cast("int")).alias("interruptions"))


def q2_segments(spark, sf_dir):
    """Speeches put together from paragraphs under their points of the agenda: texts, bills, last ordinal."""
    found = debates.speeches(debates.paragraphs(spark, write_debates(spark, sf_dir)))
    return found.groupBy("session_uid").agg(
        F.count(F.lit(1)).alias("speeches"), F.sum(F.length("text")).alias("signs"), F.countDistinct(F.when(F.col("bill_number") != "", F.col("bill_number"))).alias("bills"), F.max(F.regexp_extract("speech_id", r"__(\d+)__", 1).cast("int")).alias("last_no"),
    )


def q5_topics(spark, sf_dir):
    """What is debated: the second level of the agenda in question time, else the first."""
    found = debates.speeches(debates.paragraphs(spark, write_debates(spark, sf_dir)))
    return found.groupBy("debate_topic", "section_code").agg(F.count(F.lit(1)).alias("speeches"))


def q7_interruptions(spark, sf_dir):
    """Interruptions drawn from transcripts, and those that may be kept as lines of a person: two to fifteen words, nothing of procedure."""
    rows = debates.asides(debates.paragraphs(spark, write_debates(spark, sf_dir)), {})
    return rows.where("record = 'interruption'").groupBy("session_uid").agg(F.count(F.lit(1)).alias("interruptions"), F.sum("words").alias("words"), F.sum("keep").alias("kept"))


def q8_reactions(spark, sf_dir):
    """Applause and protest drawn from the stage directions of transcripts: their groups, and the sentence before each."""
    own = asides(spark, sf_dir).where("record_type = 'reaction' and session_uid is not null and size(group_codes) > 0")
    codes = sorted(r[0] for r in own.select(F.explode("group_codes")).distinct().limit(1000).collect())  # the chamber's groups
    what = F.when(F.col("aside_id") % 2 == 0, "Applaudissements").otherwise("Protestations")
    benches = F.when(F.size("group_codes") == 1, " sur les bancs du groupe ").otherwise(" sur les bancs des groupes ")
    direction = F.concat(F.lit("<italique>("), what, benches, F.array_join("group_codes", " et "), F.lit(".)</italique>"))
    spoken = F.concat(F.lit("Un mot. Bon "), _lettered(F.col("quote")), F.lit(". "), direction)
    number = F.col("aside_id").cast("string")
    paragraph = F.concat(F.lit('<paragraphe code_grammaire="PAROLE_GENERIQUE" id_acteur="PA'), number, F.lit('"><orateurs><orateur><nom>Orateur '), number, F.lit("</nom></orateur></orateurs><texte>"), spoken, F.lit("</texte></paragraphe>"))
    sheets = own.groupBy("session_uid").agg(F.array_join(F.collect_list(paragraph), "").alias("p"))  # a file is one sitting
    path = scratch(spark, "reactions")
    opened = F.concat(F.lit("<compteRendu><uid>"), F.col("session_uid"), F.lit("</uid><metadonnees><dateSeance>20240102150000000</dateSeance></metadonnees><contenu>"))
    sheets.select(F.col("session_uid").alias("session"), F.concat(opened, F.col("p"), F.lit("</contenu></compteRendu>")).alias("value")).write.partitionBy("session").text(path)
    rows = debates.asides(debates.paragraphs(spark, f"{path}/*/*.txt"), {c: c for c in codes})
    return rows.where("record = 'reaction'").select(F.substring("acteur_id", 3, 20).cast("bigint").alias("aside_id"), "session_uid", "kind", "quote", F.array_join("groups", ",").alias("groups"))


def s8_whole_texts(spark, sf_dir):
    """The subjects' expressions as texts whose file names hold the keys."""
    path, jvm = scratch(spark, "whole"), spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, r in enumerate(table(spark, sf_dir, "domains").orderBy("domain_id").collect(), 1):  # a fixed list
        stream = system.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{r['domain_id']}__{i:03d}__mots.txt"))
        stream.write("\n".join(r["keywords"]).encode())
        stream.close()
    read = files.whole_texts(spark, f"{path}/*.txt", r"^(?P<domain_id>.+)__(?P<no>\d+)__(?P<kind>.+)\.txt$")
    return read.select("domain_id", F.col("no").cast("int").alias("no"), "kind", F.length("text").alias("signs"))


def k3_publish(spark, sf_dir):
    """A table that is published, refused once, and published again: readers see the last whole one."""
    path = scratch(spark, "published")
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
    files.publish(own.limit(1), path)
    try:
        files.publish(own.limit(0), path, check=lambda d: not d.isEmpty())
        raise AssertionError("an empty table was published")
    except ValueError:
        pass
    files.publish(own, path, check=lambda d: not d.isEmpty())
    return spark.read.parquet(path)


def k5_bundle(spark, sf_dir):
    """Small tables as one JSON document, read again."""
    own = table(spark, sf_dir, "domains").select("domain_id", "label")
    text = files.bundle({"domains": own, "regions": table(spark, sf_dir, "region").select("r_name")})
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "domains array<struct<domain_id:string,label:string>>, regions array<struct<r_name:string>>").alias("b"))
    return one.select(F.explode("b.domains").alias("d"), F.size("b.regions").alias("regions")).select("d.*", "regions")


def k7_pages(spark, sf_dir):
    """A page in Markdown for each region with its nations."""
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return files.markdown(own, "n_regionkey", "r_name", ["n_nationkey", "n_name"], ["n_nationkey"])


_LETTERS = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[^\p{{L}}]+', ' ', 'g'))"
_PARTS = f"""parts AS (SELECT *, list_filter(list_transform(coalesce(content, []), lambda p: {_LETTERS("p")}), lambda p: p <> '') AS l, CASE WHEN section_code = 'QST_GVT' THEN 'QG' ELSE coalesce(section_code, '') END AS section FROM said WHERE session_uid IS NOT NULL), spoke AS (SELECT * FROM parts WHERE len(l) > 0)"""
_CUT = f"""cut AS (SELECT *, {words_sql("'Bon ' || " + _LETTERS("quote"))} AS own_norm FROM aside WHERE record_type = 'interruption' AND session_uid IS NOT NULL AND day IS NOT NULL)"""
_PLAIN = r"trim(regexp_replace(coalesce(array_to_string(content, ' '), ''), '[^\p{L}]+', ' ', 'g'))"
_ALL = {
    "s4_json_lines": (s4_json_lines, "SELECT record_type, count(*) AS n, count(DISTINCT aside_id) AS ids, sum(words)::BIGINT AS words, sum(len(coalesce(group_codes, [])))::BIGINT AS groups FROM asides GROUP BY 1"),
    "s5_json_files": (s5_json_files, "SELECT domain_id, len(keywords)::INTEGER AS expressions, array_to_string(keywords, '|') AS joined FROM domains"),
    "s6_zip": (s6_zip, "SELECT coalesce(party, '') AS party, count(*) AS n, sum(pid)::BIGINT AS pids, max(full_name) AS last_name, min(acteur_id || '.json') AS first_member FROM politicians GROUP BY 1"),
    "s7_text_lines": (s7_text_lines, r"WITH l AS (SELECT session_uid, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS t, regexp_replace(quote, '\s+', ' ', 'g') AS q FROM asides WHERE quote <> '' AND session_uid IS NOT NULL) SELECT session_uid, count(*) AS lines, sum(length(q))::BIGINT AS signs FROM l WHERE t <> '' GROUP BY 1"),
    "s9_csv": (s9_csv, "SELECT unnest(['plain', 'excel']) AS way, n, numbers, people, departments FROM (SELECT count(*) AS n, sum(constituency_no)::BIGINT AS numbers, count(DISTINCT acteur_id) AS people, count(DISTINCT CASE WHEN department_name <> '' THEN department_name END) AS departments FROM seats)"),
    "s10_xlsx": (s10_xlsx, "SELECT n_name AS name, 'région ' || n_regionkey AS region, n_nationkey::INTEGER AS key FROM nation"),
    "s11_sqlite": (s11_sqlite, "SELECT source, target_share AS share, max_repeats AS cap FROM source_targets WHERE max_repeats > 0"),
    "s2_metadata": (s2_metadata, f"""WITH {SAID}, {ASIDES}, {_PARTS}, {_CUT}, p AS (SELECT session_uid, sum(len(l)) AS n FROM spoke GROUP BY 1), i AS (SELECT session_uid, count(*) AS n FROM cut GROUP BY 1)
        SELECT session_uid, '2024-01-02' AS day, '7' AS sitting, coalesce(p.n, 0)::BIGINT AS paragraphs, coalesce(i.n, 0)::BIGINT AS interruptions FROM p FULL JOIN i USING (session_uid)"""),
    "q2_segments": (q2_segments, f"""WITH {SAID}, {_PARTS} SELECT session_uid, count(*) AS speeches, sum(length(array_to_string(l, chr(10) || chr(10))))::BIGINT AS signs, count(DISTINCT nullif(bill_number, '')) AS bills, count(*)::INTEGER AS last_no FROM spoke GROUP BY 1"""),
    "q5_topics": (q5_topics, f"""WITH {SAID}, {_PARTS}, t AS (SELECT section, {_LETTERS("debate_title")} AS a, {_LETTERS("dossier_title")} AS b FROM spoke) SELECT CASE WHEN section = 'QG' AND b <> '' THEN b ELSE a END AS debate_topic, section AS section_code, count(*) AS speeches FROM t GROUP BY ALL"""),
    "q7_interruptions": (q7_interruptions, f"""WITH {ASIDES}, {_CUT}, w AS (SELECT session_uid, len(list_filter(string_split(own_norm, ' '), lambda t: t <> '')) AS n, regexp_matches(own_norm, '(^| )(demande la parole|s il vous pla[iî]t|veuillez|je retire mon)( |$)') AS formal FROM cut)
        SELECT session_uid, count(*) AS interruptions, sum(n)::BIGINT AS words, sum((n BETWEEN 2 AND 15 AND NOT formal)::INT)::BIGINT AS kept FROM w GROUP BY 1"""),
    "q8_reactions": (q8_reactions, f"""WITH {ASIDES} SELECT aside_id, session_uid, CASE WHEN aside_id % 2 = 0 THEN 'applaudissement' ELSE 'protestation' END AS kind, trim('Bon ' || {_LETTERS("quote")}) || '.' AS quote, array_to_string(list_sort(list_distinct(group_codes)), ',') AS groups
        FROM aside WHERE record_type = 'reaction' AND session_uid IS NOT NULL AND len(group_codes) > 0"""),
    "s8_whole_texts": (s8_whole_texts, "SELECT domain_id, row_number() OVER (ORDER BY domain_id)::INTEGER AS no, 'mots' AS kind, length(array_to_string(keywords, chr(10)))::INTEGER AS signs FROM domains"),
    "k3_publish": (k3_publish, "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1"),
    "k5_bundle": (k5_bundle, "SELECT domain_id, label, (SELECT count(*) FROM region)::INTEGER AS regions FROM domains"),
    "k7_pages": (k7_pages, "SELECT n_regionkey, '# ' || any_value(r_name) || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS page FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "s1_transcripts": (s1_transcripts, f"WITH {SAID}, t AS (SELECT session_uid, {_PLAIN} AS t FROM said WHERE session_uid IS NOT NULL) SELECT session_uid, count(*) AS speeches, sum(length(t))::BIGINT AS signs, '2024-01-02' AS day FROM t WHERE t <> '' GROUP BY 1"),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
