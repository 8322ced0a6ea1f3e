"""Register sources: nine CSV and JSON files in one record shape and one statement shape.

All CSV columns are read as text under an explicit schema, so identifiers keep their zeros and dates their precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = ["record_id", "source", "entity_type", "name", "jurisdiction", "address", "birth_date", "identifier", "aliases", "topics", "raw"]
STATEMENT = ["statement_id", "source", "subject_record_id", "interested_record_id", "interest_type", "share_percent", "confidence", "retrieved_at", "raw"]
# Kinds of sanctioned parties.
SDN_TYPES = {"individual": "person", "person": "person", "entity": "company", "": "person"}


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column text, blanks empty."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(path).fillna("")


def _records(df: DataFrame, **cols: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    whole = {c: F.lit("") for c in RECORD[:8]} | {"aliases": none, "topics": none, "raw": F.create_map().cast("map<string,string>")} | cols
    return df.select(*[F.coalesce(whole[c], F.lit("")).alias(c) if c in RECORD[:8] else whole[c].alias(c) for c in RECORD])


def _statements(df: DataFrame, **cols: Column) -> DataFrame:
    whole = {c: F.lit("") for c in STATEMENT} | {"share_percent": F.lit(0.0), "confidence": F.lit(1.0), "raw": F.create_map().cast("map<string,string>")} | cols
    return df.select(*[whole[c].alias(c) for c in STATEMENT])


def numbered(df: DataFrame) -> DataFrame:
    """df with n, from 0 in the order of the file: the row's place in its partition after all rows of earlier ones."""
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sums = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("here"))  # a row for each partition
    before = sums.select("__part", (F.sum("here").over(Window.orderBy("__part")) - F.col("here")).alias("before"))
    joined = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn("n", F.col("before") + F.col("__id").bitwiseAND(F.lit(2**33 - 1))).drop("__id", "__part", "before")


def in_order(source: int) -> Column:
    """A number that orders rows by source, then by their place in it: bits 60 and up are the source's, the rest hold more
    partitions than a job can have."""
    return F.lit(source << 60) + F.monotonically_increasing_id()


def first(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def opensanctions(spark: SparkSession, folder: str) -> DataFrame:
    many = ["name", "birthDate", "nationality", "jurisdiction", "incorporationDate", "address", "leiCode", "topics", "position"]
    schema = "entities array<struct<id:string,schema:string,properties:struct<" + ",".join(f"{c}:array<string>" for c in many) + ">,first_seen:string,last_seen:string>>"
    e = spark.read.option("multiLine", True).schema(schema).json(f"{folder}/opensanctions.ftm.json").select(F.explode("entities").alias("e")).select("e.*")
    p = lambda c: F.col(f"properties.{c}")
    rest = F.coalesce(F.slice(p("name"), F.lit(2), F.greatest(F.size(p("name")), F.lit(1))), F.array().cast("array<string>"))
    where = F.when(first(p("jurisdiction")) != "", first(p("jurisdiction"))).otherwise(first(p("nationality")))
    return _records(
        e, record_id=F.col("id"), source=F.lit("opensanctions"), entity_type=F.when(F.col("schema") == "Person", "person").otherwise("company"), name=first(p("name")), jurisdiction=where, address=first(p("address")), birth_date=first(p("birthDate")),
        identifier=first(p("leiCode")), aliases=rest, topics=F.coalesce(p("topics"), F.array().cast("array<string>")), raw=F.create_map(F.lit("position"), first(p("position")), F.lit("last_seen"), F.coalesce("last_seen", F.lit(""))),
    )


def gleif_level1(spark: SparkSession, folder: str) -> DataFrame:
    d = csv(spark, f"{folder}/gleif_level1.csv", ["LEI", "Entity.LegalName", "Entity.LegalJurisdiction", "Entity.LegalForm", "Entity.LegalAddress", "Entity.EntityStatus", "Registration.InitialRegistrationDate"])
    return _records(d, record_id=F.concat(F.lit("lei-"), "LEI"), source=F.lit("gleif_l1"), entity_type=F.lit("company"), name=F.col("`Entity.LegalName`"), jurisdiction=F.col("`Entity.LegalJurisdiction`"), address=F.col("`Entity.LegalAddress`"), identifier=F.col("LEI"), raw=F.create_map(F.lit("status"), F.col("`Entity.EntityStatus`")))


def gleif_level2(spark: SparkSession, folder: str) -> DataFrame:
    """The start of a relationship is the child; its end the parent."""
    names = ["Relationship.StartNode.NodeID", "Relationship.EndNode.NodeID", "Relationship.RelationshipType", "Relationship.Status", "Registration.ValidationSources"]
    d = csv(spark, f"{folder}/gleif_level2.csv", names)
    d = numbered(d)
    return _statements(
        d, statement_id=F.format_string("gleif-l2-%05d", "n"), source=F.lit("gleif_l2"), subject_record_id=F.concat(F.lit("lei-"), F.col(f"`{names[0]}`")), interested_record_id=F.concat(F.lit("lei-"), F.col(f"`{names[1]}`")),
        interest_type=F.lit("consolidation"), confidence=F.when(F.col(f"`{names[4]}`") == "FULLY_CORROBORATED", 1.0).otherwise(0.6), raw=F.create_map(F.lit("relationship"), F.col(f"`{names[2]}`")),
    )


def openownership(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two records and a statement for each filing; of several interests the first counts."""
    schema = (
        "statements array<struct<statementID:string,statementType:string,statementDate:string,subject:struct<describedByEntityStatement:string,name:string,jurisdiction:string>,"
        "interestedParty:struct<describedByPersonStatement:string,describedByEntityStatement:string,type:string,name:string,birthDate:string,nationality:string,jurisdiction:string,address:struct<full:string>>,"
        "interests:array<struct<type:string,share:struct<exact:double>,startDate:string>>,source:struct<retrievedAt:string>>>"
    )
    s = spark.read.option("multiLine", True).schema(schema).json(f"{folder}/openownership_psc.json").select(F.posexplode("statements").alias("n", "s")).select("n", "s.*")
    party = F.col("interestedParty")
    party_id = F.coalesce(party["describedByPersonStatement"], party["describedByEntityStatement"])
    subjects = _records(s, record_id=F.col("subject.describedByEntityStatement"), source=F.lit("openownership"), entity_type=F.lit("company"), name=F.col("subject.name"), jurisdiction=F.col("subject.jurisdiction"))
    parties = _records(s, record_id=party_id, source=F.lit("openownership"), entity_type=F.when(party["type"] == "individual", "person").otherwise("company"), name=party["name"], jurisdiction=F.when(F.coalesce(party["jurisdiction"], F.lit("")) != "", party["jurisdiction"]).otherwise(party["nationality"]), address=party["address"]["full"], birth_date=party["birthDate"])
    interest = F.try_element_at("interests", F.lit(1))
    statements = _statements(s, statement_id=F.col("statementID"), source=F.lit("openownership"), subject_record_id=F.col("subject.describedByEntityStatement"), interested_record_id=party_id, interest_type=F.coalesce(interest["type"], F.lit("shareholding")), share_percent=F.coalesce(interest["share"]["exact"], F.lit(0.0)), retrieved_at=F.coalesce(F.col("source.retrievedAt"), F.lit("")))
    return subjects.unionByName(parties), statements


def companies_house(spark: SparkSession, folder: str) -> DataFrame:
    d = csv(spark, f"{folder}/companies_house.csv", ["company_number", "company_name", "company_status", "jurisdiction", "date_of_creation", "registered_office_address", "sic_code"])
    return _records(d, record_id=F.concat(F.lit("ch-"), "company_number"), source=F.lit("companies_house"), entity_type=F.lit("company"), name=F.col("company_name"), jurisdiction=F.col("jurisdiction"), address=F.col("registered_office_address"), identifier=F.col("company_number"), raw=F.create_map(F.lit("status"), F.col("company_status"), F.lit("sic"), F.col("sic_code")))


def ofac(spark: SparkSession, folder: str) -> DataFrame:
    d = csv(spark, f"{folder}/ofac_sdn.csv", ["ent_num", "SDN_Name", "SDN_Type", "Program", "Nationality", "DOB", "Remarks"])
    kinds = F.create_map(*[F.lit(x) for kv in SDN_TYPES.items() for x in kv])
    turned = F.when(F.instr("SDN_Name", ",") > 0, F.concat_ws(" ", F.trim(F.split_part("SDN_Name", F.lit(","), F.lit(2))), F.trim(F.split_part("SDN_Name", F.lit(","), F.lit(1))))).otherwise(F.col("SDN_Name"))
    return _records(d, record_id=F.concat(F.lit("ofac-"), "ent_num"), source=F.lit("ofac"), entity_type=F.coalesce(F.try_element_at(kinds, F.lower(F.trim("SDN_Type"))), F.lit("person")), name=F.initcap(F.lower(turned)), jurisdiction=F.col("Nationality"), birth_date=F.col("DOB"), identifier=F.col("ent_num"), topics=F.array(F.lit("sanction")), raw=F.create_map(F.lit("program"), F.col("Program")))


def icij(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = csv(spark, f"{folder}/icij_offshore_nodes.csv", ["node_id", "name", "node_type", "jurisdiction_description", "address", "sourceID"])
    records = _records(d, record_id=F.col("node_id"), source=F.lit("icij"), entity_type=F.when(F.col("node_type") == "officer", "person").otherwise("company"), name=F.col("name"), jurisdiction=F.col("jurisdiction_description"), address=F.col("address"))
    e = csv(spark, f"{folder}/icij_offshore_edges.csv", ["node_id_start", "node_id_end", "rel_type", "link", "start_date", "sourceID"])
    e = numbered(e)
    share = F.coalesce(F.expr(r"try_cast(regexp_extract(link, '\\((\\d+(?:\\.\\d+)?)\\s*%\\)', 1) as double)"), F.lit(0.0))
    kind = F.when(F.col("rel_type") == "shareholder_of", "shareholding").otherwise(role("link"))
    return records, _statements(e, statement_id=F.format_string("icij-%05d", "n"), source=F.lit("icij"), subject_record_id=F.col("node_id_end"), interested_record_id=F.col("node_id_start"), interest_type=kind, share_percent=share, confidence=F.lit(0.75))


def role(link: str) -> Column:
    low = F.lower(link)
    return F.when(low.contains("trustee"), "trusteeship").when(low.contains("director"), "directorship").otherwise("control")


def aggregator(spark: SparkSession, folder: str) -> DataFrame:
    d = csv(spark, f"{folder}/aggregator_extract.csv", ["record_id", "entity_type", "name", "jurisdiction", "address", "birth_date", "source_register"])
    return _records(d, record_id=F.col("record_id"), source=F.lit("aggregator"), entity_type=F.col("entity_type"), name=F.col("name"), jurisdiction=F.col("jurisdiction"), address=F.col("address"), birth_date=F.col("birth_date"), raw=F.create_map(F.lit("register"), F.col("source_register")))


def first_wins(records: DataFrame) -> DataFrame:
    """One row per record_id: the one that was loaded first."""
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("load_seq"))
    return records.withColumn("__n", n).where("__n = 1").drop("__n")


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records (first of each id, with load_seq) and statements (with stmt_seq) of all files."""
    filed, filings = openownership(spark, folder)
    nodes, links = icij(spark, folder)
    parts = [opensanctions(spark, folder), gleif_level1(spark, folder), filed, companies_house(spark, folder), ofac(spark, folder), nodes, aggregator(spark, folder)]
    records = None
    for i, part in enumerate(parts):
        part = part.withColumn("load_seq", in_order(i))
        records = part if records is None else records.unionByName(part)
    statements = None
    for i, part in enumerate((gleif_level2(spark, folder), filings, links)):
        part = part.withColumn("stmt_seq", in_order(i))
        statements = part if statements is None else statements.unionByName(part)
    return first_wins(records), statements


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("records")).orderBy("source")
