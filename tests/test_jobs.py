"""The two jobs, end to end on the sample mailbox."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedup, messages
from postmill.plans import jobs
from postmill.sinks import writers
from postmill.sources import readers, sample


@pytest.fixture(scope="module")
def mailbox(spark, sf_dir):
    return sample.mailbox(spark, sf_dir)


def test_extract_all_formats(spark, sf_dir, mailbox, tmp_path):
    options = jobs.Options(formats=["JSON", "csv", "eml", "mbox"], deduplicate=True, mask=True, index=True, compress=True)
    result = jobs.extract(spark, mailbox, str(tmp_path), options, sample.attachments(spark, sf_dir))
    unique = dedup.keep_first(messages.build_records(mailbox), F.col("Email_ID"))
    n = unique.count()
    assert result.email_count == n < mailbox.count()
    csv = writers.read_csv(spark, result.paths["csv"])
    json = spark.read.json(result.paths["json"])
    assert csv.count() == json.count() == n == spark.read.parquet(result.paths["eml"]).count()
    assert spark.read.parquet(result.paths["index"]).count() == n
    starts = spark.read.text(result.paths["mbox"]).where(F.col("value").startswith("From - ")).count()
    assert starts == n
    for df in (csv, json):
        masked = df.where(F.col("To").contains("@") | F.col("CC").contains("@") | F.col("Body").rlike(r"[\w.]+@\w+\.\w{2,}"))
        assert masked.count() == 0
    stored = spark.read.parquet(result.paths["attachments"])
    assert stored.count() == stored.select("path").distinct().count() == result.attachments_saved > 0
    counted = json.agg(F.sum(F.size("Attachment_Paths"))).first()[0]
    assert counted == result.attachments_saved
    assert json.where("size(Attachment_Paths) > 0 and Attachment_Count <> size(Attachment_Paths)").count() == 0


def test_extract_with_spelling(spark, sf_dir, mailbox, tmp_path):
    options = jobs.Options(mask=True, dictionary=sample.dictionary(spark, sf_dir))
    result = jobs.extract(spark, mailbox, str(tmp_path), options)
    back = spark.read.json(result.paths["json"])
    assert back.count() == result.email_count == mailbox.count()
    assert back.where("`To` not like '%<EMAIL>%'").count() == 0


def test_attachments_of_equal_ids_do_not_overwrite_each_other(spark):
    records = spark.createDataFrame(
        [("/Root/A", i, i, "same") for i in range(3)], "folder_path string, pos long, scan_pos long, Email_ID string")
    att = spark.createDataFrame(
        [("/Root/A", m, i, "x.txt", "", "", "3", b"abc") for m in range(3) for i in range(2)],
        "folder_path string, message_index long, attachment_index long, long_filename string, file_name string, "
        "name string, size string, content binary")
    paths = [r["path"] for r in jobs.stored_attachments(records, records, att).orderBy("scan_pos", "attachment_index").collect()]
    assert paths == ["same/x.txt"] + [f"same/x_{k}.txt" for k in range(2, 7)]


def test_addresses_job(spark, mailbox, tmp_path):
    result = jobs.addresses(mailbox, str(tmp_path), jobs.Options(formats=["json", "csv"]))
    assert result.address_count > 0 and result.host_count > 0
    assert spark.read.json(result.paths["addresses"]).count() == result.address_count
    assert writers.read_csv(spark, result.paths["hosts_csv"], ["Host", "Count"]).count() == result.host_count
    mentions = spark.read.json(result.paths["addresses"]).agg(F.sum("Count")).first()[0]
    from postmill.operators.addresses import explode_addresses
    assert mentions == explode_addresses(messages.build_records(mailbox)).count()


def test_wrong_formats_and_empty_mailboxes(spark, mailbox, tmp_path):
    with pytest.raises(ValueError):
        jobs.addresses(mailbox, str(tmp_path), jobs.Options(formats=["eml"]))
    with pytest.raises(ValueError):
        jobs.extract(spark, mailbox, str(tmp_path), jobs.Options(formats=["pdf"]))
    with pytest.raises(RuntimeError):
        jobs.addresses(mailbox.where("false"), str(tmp_path), jobs.Options(formats=["json"]))


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    body = 'line one\nline "two", and\r\nthree\\ '
    df = spark.createDataFrame([("id", body, 0, ["a b"])], "Email_ID string, Body string, Attachment_Count int, Attachment_Paths array<string>")
    back = writers.read_csv(spark, writers.write_csv(df, str(tmp_path / "c"))).first()
    assert back["Body"] == body and back["Attachment_Count"] == "" and back["Attachment_Paths"] == '["a b"]'
    assert back["Subject"] == ""


def test_mbox_escapes_from_lines(spark):
    from postmill.sinks.render import mbox_text
    df = spark.createDataFrame(
        [("id", "S", "f@x", "t@x", "", "", 0.0, "<m>", None, "From here\nand From there")],
        "Email_ID string, Subject string, `From` string, `To` string, CC string, BCC string, Date_Received_Timestamp double, "
        "Message_ID string, Full_Headers string, Body string")
    out = df.select(mbox_text()).first()[0]
    assert out.startswith("From - Thu Jan 01 00:00:00 1970\nSubject: S\n")
    assert "\n>From here\nand From there\n" in out and "Date: Thu, 01 Jan 1970 00:00:00 GMT" in out


def test_broken_lines_are_marked_and_dropped(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"folder_path": "/Root/A", "pos": 1}\n{"folder_path": "/Root\n{"pos": 2}\n')
    assert readers.read_messages(spark, str(tmp_path), "json").count() == 2
    kept = readers.read_messages(spark, str(tmp_path), "json", keep_unparsed=True).select("pos", "_corrupt_record")
    assert [r["pos"] for r in kept.collect() if r["_corrupt_record"]] == [None]


def test_stored_files_can_be_read_back(spark, tmp_path):
    (tmp_path / "id1").mkdir()
    (tmp_path / "id1" / "a.txt").write_bytes(b"hello")
    row = readers.read_attachment_files(spark, str(tmp_path)).first()
    assert row["path"].endswith("id1/a.txt") and row["size"] == 5 and bytes(row["content"]) == b"hello"


def test_keyed_members_form_one_document(spark):
    import json
    df = spark.createDataFrame([("a", 'say "x"', None), ("b", "é", 1)], "Email_ID string, Subject string, n int")
    members = [r["member"] for r in writers.keyed_document(df).collect()]
    document = json.loads("{" + ",".join(members) + "}")
    assert document == {"a": {"Email_ID": "a", "Subject": 'say "x"', "n": None}, "b": {"Email_ID": "b", "Subject": "é", "n": 1}}


def test_intermediates_go_to_the_folder_the_cluster_names():
    from postmill import shared_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    assert shared_dir(Session(), "names").startswith("hdfs://shared/checkpoints/names-")
    bare = Session()
    bare.conf = Conf({"spark.master": "spark://head:7077"})
    with pytest.raises(RuntimeError, match="share"):
        shared_dir(bare, "a")
    bare.conf = Conf({"spark.master": "local[2]"})
    first, second = shared_dir(bare, "a"), shared_dir(bare, "b")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
