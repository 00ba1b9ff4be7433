import csv
import gzip
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ratebook import sources as S
from ratebook.plans import normalize as N
from ratebook.schema import LOCATION_CROSSWALK, NESTED_SERVICE, strings
from ratebook.sources import digest


def uri(path):
    return f"file:{path}"


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "311")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_records_equal_the_csv_module(spark, tmp_path, small_blocks):
    random.seed(7)
    cells = ["x", '5" pipe, long', "multi\nline", 'multi\r\nline "q", z', "", '"', '""', "\n", '\n",\n"', '"start',
             'end"', 'a","b', ",", " pad "]
    expected = {}
    for f, newline in enumerate(["\n", "\r\n"]):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=newline)
        writer.writerow(["hospital_name", "License Number|CA", "x y", "X-Y", ""])
        writer.writerow(['A "B", C', " ", "1", "2", "z"])
        writer.writerow(["a", "b", "c"])
        for i in range(80):
            if random.random() < 0.1:
                out.write(newline)
            elif random.random() < 0.1:
                out.write(f'raw 5" tube,y,z{newline}')
            else:
                writer.writerow([i, random.choice(cells), random.choice(cells)])
        raw = ("﻿" if f else "") + out.getvalue()
        path = tmp_path / f"f{f}.csv"
        path.write_bytes(raw.encode())
        parsed = list(csv.reader(io.StringIO(raw.lstrip("﻿"), newline="")))
        expected[uri(path)] = [(n - 2, r) for n, r in enumerate(parsed) if n > 2 and r]
    found = {}
    for r in S.scan_preamble_csv(spark, str(tmp_path)).collect():
        found.setdefault(r.source_file, []).append((r.source_row_number, r.cells))
    assert {k: sorted(v) for k, v in found.items()} == expected

    headers, _ = S.scan_price_csv(spark, str(tmp_path))
    for r in S.file_metadata(headers).collect():
        assert r.metadata == {
            "mrf_meta__hospital_name": 'A "B", C', "mrf_meta__license_number_ca": None, "mrf_meta__x_y": "1",
            "mrf_meta__x_y_2": "2",
        }


def test_array_elements_and_metadata_of_nested_files(spark, tmp_path, small_blocks):
    random.seed(3)
    texts = ["abc", 'q"uo}te', "br{ace [x] } ]", "back\\slash", '\\"', "", " ", "é}"]
    expected = {}
    for f in range(3):
        services = [
            {
                "description": random.choice(texts),
                "code_information": [{"code": random.choice(texts), "type": "T"}] * random.randint(0, 2),
                "standard_charges": [{"setting": random.choice(texts), "payers_information": [{"payer_name": "p"}]}],
            }
            for _ in range(40)
        ]
        if f == 2:
            services = []
        document = {
            "hospital_name": "H}", "modifier_information": [{"a": {"b": [1]}}, {"c": 2}],
            "location_name": [" L ", "x"], "license_information": {"license_number": "7"},
            "standard_charge_information": services, "more": [{"x": 1}], "version": "2.0",
        }
        path = tmp_path / f"f{f}.json"
        path.write_text(json.dumps(document, indent=2 if f == 0 else None) + ("\n" if f else ""))
        expected[uri(path)] = list(enumerate(services, 1))
    found = {k: [] for k in expected}
    for r in S.nested_json.scan_array_elements(spark, str(tmp_path)).collect():
        found[r.source_file].append((r.service_number, json.loads(r.element)))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()} == expected
    meta = S.nested_file_metadata(spark, str(tmp_path)).collect()
    assert len(meta) == 3
    assert {(r.mrf_hospital_name, r.mrf_location_name, r.mrf_license_number, r.mrf_version) for r in meta} == {
        ("H}", "L", "7", "2.0")
    }
    whole = S.scan_nested_json(spark, str(tmp_path))
    assert whole.select(F.explode("standard_charge_information")).count() == 80


@pytest.mark.parametrize("size", [1, 60, 2**20])
def test_chunks_of_nested_files(spark, tmp_path, monkeypatch, size):
    """Text is written in the order of the scan, without a shuffle, and elements that go beyond a chunk are put together."""
    services = [{"description": f'a "{i}" {{ \\', "charges": [{"n": k, "t": "}]"} for k in range(i % 4)]} for i in range(30)]
    document = {"hospital_name": "H", "more": [{"x": [1]}], "standard_charge_information": services, "version": "2.0"}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({**document, "standard_charge_information": []}))
    written, write = {}, S.nested_json.staged
    monkeypatch.setattr(S.nested_json, "CHUNK", size)
    monkeypatch.setattr(S.nested_json, "staged", lambda df, name: written.update({name: df._jdf.queryExecution().toString()}) or write(df, name))
    found = S.nested_json.scan_array_elements(spark, str(tmp_path)).collect()
    assert [json.loads(r.element) for r in sorted(found, key=lambda r: r.service_number)] == services
    assert {r.mrf_version for r in S.nested_file_metadata(spark, str(tmp_path)).collect()} == {"2.0"}
    assert "Exchange hashpartitioning" not in written["json-chunks"] + written["json-elements"]


def test_lines_are_located_without_a_shuffle(spark, tmp_path, monkeypatch, small_blocks):
    records = [["a", "b"], ["x", "y"], ["n", "t"], *[[str(i), "\n".join("z" * (i % 4 + 1))] for i in range(50)]]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(records)
    written, write = {}, S.preamble_csv.staged
    monkeypatch.setattr(S.preamble_csv, "staged", lambda df, name: written.update({name: df._jdf.queryExecution().toString()}) or write(df, name))
    found = S.scan_preamble_csv(spark, str(tmp_path)).collect()
    assert [r.cells for r in sorted(found, key=lambda r: r.source_row_number)] == records[3:]
    assert "Exchange" not in written["csv-lines"]


def _price_file(path, header, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["hospital_name", "location_name", "hospital_address", "type_2_npi", "license_number|CA", "version"])
        w.writerow(["Hosp", " Loc ", "1 Main, Town, CA 90001", "", "L1", "2.0"])
        w.writerow(header)
        w.writerows(rows)


WIDE = ["description", "code|1", "code|1|type", "Modifiers ", "setting", "standard_charge|gross",
        "standard_charge|[P]|[A]|negotiated_dollar", "count|[P]|[A]", "standard_charge|[P]|[B]|negotiated_percentage",
        "standard_charge|[P]|[B]|negotiated_algorithm"]


def test_normalize_wide(spark, tmp_path, rows):
    _price_file(tmp_path / "a.csv", WIDE, [
        ["knee\nsurgery", "470", "MS-DRG", "TC", "inpatient", "$2,000.00", "$1,000.50", "1 through 10", "", ""],
        ["none", "1", "CPT", "", "both", "5", "", " ", "", ""],
        ["junk", "2", "CPT", "", "both", "x", "n/a", "", "12%", "x + 1"],
    ])
    # another file of the same system, with other payers and another column order
    _price_file(tmp_path / "b.csv", ["standard_charge|[Q]|[Z]|negotiated_dollar", "description", "modifiers", "code|1"],
                [["7", "d", "m", "9"]])
    manifest = spark.createDataFrame(
        [(uri(tmp_path / "a.csv"), "000001", "S"), (uri(tmp_path / "b.csv"), "000002", "S")],
        "source_file string, facility_id string, system_name string",
    )
    out = N.price_fact(N.normalize_wide(spark, str(tmp_path), manifest))
    cols = ["facility_id", "source_row_number", "description", "code_1", "modifier", "modifiers", "gross_charge",
            "payer", "plan", "negotiated_dollar", "negotiated_percentage", "negotiated_algorithm",
            "negotiated_count", "price_representation"]
    assert rows(out, *cols) == sorted([
        ("000001", 1, "knee\nsurgery", "470", "TC", None, 2000.0, "P", "A", 1000.5, None, None, "1 through 10", "dollar"),
        ("000001", 3, "junk", "2", None, None, None, "P", "B", None, 12.0, "x + 1", None, "percentage_algorithm"),
        ("000002", 1, "d", "9", None, "m", None, "Q", "Z", 7.0, None, None, None, "dollar"),
    ], key=repr)


def test_uneven_rows_and_repeated_metrics_fail(spark, tmp_path):
    _price_file(tmp_path / "a.csv", WIDE, [["only", "two"]])
    manifest = spark.createDataFrame([(uri(tmp_path / "a.csv"), "1")], "source_file string, facility_id string")
    with pytest.raises(Exception, match="uneven row 1"):
        N.normalize_wide(spark, str(tmp_path), manifest).collect()
    tall = tmp_path / "tall"
    tall.mkdir()
    _price_file(tall / "t.csv", ["description", "standard_charge|negotiated_dollar"], [["d", "5"]])
    other = spark.createDataFrame([(uri(tall / "other.csv"), "1")], "source_file string, facility_id string")
    with pytest.raises(Exception, match="not in the manifest"):
        N.normalize_tall(spark, str(tall), other).count()
    twice = tmp_path / "twice"
    twice.mkdir()
    _price_file(twice / "b.csv", [*WIDE, WIDE[6]], [])
    with pytest.raises(Exception, match="occurs twice"):
        N.wide_layouts(S.scan_price_csv(spark, str(twice))[0]).collect()


def test_normalize_tall(spark, tmp_path, rows):
    header = ["description", "code|1", "code|1|type", "code|2", "code|2|type", "payer_name", "plan_name",
              "standard_charge|negotiated_dollar", "standard_charge|negotiated_algorithm"]
    _price_file(tmp_path / "a.csv", header, [
        ["a", " ", "CPT", "99213", "", "P", "A", "$5", "alg"],
        [],
        ["no price", "1", "CPT", "", "", "P", "A", "", ""],
        ["short", "1", "CPT", "", "", "P", "A", "6"],
    ])
    manifest = spark.createDataFrame([(uri(tmp_path / "a.csv"), "000123", "S")],
                                     "source_file string, facility_id string, system_name string")
    out = N.normalize_tall(spark, str(tmp_path), manifest)
    assert rows(out, "source_record_id", "code_1", "code_1_type", "code_2", "all_codes_json", "negotiated_dollar",
                "price_representation", "mrf_location_name", "mrf_license_number", "mrf_type_2_npi") == [
        ("000123|1", "99213", None, None, '[{"code":"99213","type":null}]', 5.0, "dollar_algorithm", "Loc", "L1", None),
        ("000123|4", "1", "CPT", None, '[{"code":"1","type":"CPT"}]', 6.0, "dollar", "Loc", "L1", None),
    ]


def test_flatten_services(spark, rows):
    service = {
        "description": " d ", "code_information": [{"code": "1", "type": "T"}], "drug_information": {"unit": "2.0"},
        "standard_charges": [
            {"setting": "both", "payers_information": [
                {"payer_name": "p", "standard_charge_dollar": "1.5"}, {"payer_name": "q", "count": "1 through 10"}]},
            {"setting": "x", "payers_information": None},
        ],
    }
    text = [(1, json.dumps(service)), (2, json.dumps({"description": "gone"})), (3, '{"standard_charges": []}')]
    services = spark.createDataFrame(text, "service_number long, j string").select(
        F.lit("f").alias("source_file"), "service_number", F.from_json("j", NESTED_SERVICE).alias("service")
    )
    out = N.flatten_services(services)
    assert rows(out, "source_record_id", "description", "drug_unit", "all_codes_json", "payer", "negotiated_dollar",
                "negotiated_count", "price_representation") == [
        ("1:1:1", "d", "2", '[{"code":"1","type":"T"}]', "p", 1.5, None, "dollar"),
        ("1:1:2", "d", "2", '[{"code":"1","type":"T"}]', "q", None, "1 through 10", "none"),
    ]


def test_manifest(spark, tmp_path, rows):
    (tmp_path / "m.txt").write_text(
        "mrf-url: https://early\nlocation-name: A\n\nmrf-url: https://x:8080/y\nunknown: z\nnoise\n"
        "location-name: B\ncontact-name: one\ncontact-name: two\n"
    )
    out = S.parse_kv_manifest(S.read_manifest_lines(spark, str(tmp_path)))
    assert rows(out, "location_name", "mrf_url", "contact_name") == sorted(
        [(None, "https://early", None), ("A", "https://x:8080/y", None), ("B", None, "two")], key=repr
    )


def test_segments_do_not_depend_on_the_chunk(spark, rows):
    df = spark.range(50).select(F.lit("f").alias("k"), F.col("id").alias("n"))
    starts = F.col("n") % 7 == 3
    a, b = (S.segment_records(df, ["k"], "n", starts, chunk=c) for c in (4, 1000))
    assert rows(a, "n", "record_number") == rows(b, "n", "record_number")


def test_registries_crosswalks_and_zone_json(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_text("location_name,facility_id,status\nA,050760,include\nB,,skip\n")
    cross = S.read_crosswalk(spark, str(tmp_path / "c.csv"), LOCATION_CROSSWALK)
    assert rows(cross) == [("A", "050760", "include"), ("B", None, "skip")]
    assert S.require_one(cross, F.col("location_name") == "A", "A")["status"] == "include"
    with pytest.raises(LookupError):
        S.require_one(cross, F.col("location_name") == "Z", "Z")
    (tmp_path / "z.json").write_text('[["NAME","P"],\n["z1","5"],\n["z2",null]]')
    zones = S.scan_header_array_json(spark, str(tmp_path / "z.json"), {"P": "population", "NAME": "n", "Q": "q"})
    assert rows(zones) == [("5", "z1", None), (None, "z2", None)]
    (tmp_path / "r.json").write_text('[{"facility_id": "007", "n": 1}, {"facility_id": null}]')
    assert rows(S.scan_json_records(spark, str(tmp_path / "r.json"), strings("facility_id"))) == [("007",), (None,)]


def test_inventory_and_hashes(spark, tmp_path, rows):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, text in {"a.csv": "same", "b.csv": "same", "c.csv": "other!"}.items():
        (raw / name).write_text(text)
    hashes = rows(S.content_hash(spark, str(raw)).select(F.regexp_extract("path", "([^/]+)$", 1), "sha256"))
    assert hashes == [(n, hashlib.sha256((raw / n).read_bytes()).hexdigest()) for n in ("a.csv", "b.csv", "c.csv")]
    manifest = spark.createDataFrame([("a",), ("z",)], "slug string")
    out = S.file_inventory(spark, {"raw": str(raw)}, manifest)
    assert rows(out, "slug", "raw_exists", "complete") == [("a", True, True), ("z", False, False)]


def test_digest_is_taken_up_again():
    data = bytes(range(256)) * 3
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 768):
        for step in (1, 7, 63, 64, 65, 200):
            state = digest.start()
            for at in range(0, size, step):
                state = digest.update(state, data[at : min(at + step, size)])
            assert digest.n_bytes(state) == size
            assert digest.finish(state) == hashlib.sha256(data[:size]).hexdigest()


def test_files_that_do_not_fit_a_row_are_hashed(spark, tmp_path, rows):
    """Files above the largest content of a row (here 40,000 bytes, by default 2 GB) are digested range by range."""
    raw, n = tmp_path / "raw", random.Random(1)
    (raw / "a" / "b").mkdir(parents=True)
    lines = b"".join(b"%d,%s\r\n" % (i, b"x" * n.randrange(90)) for i in range(2000))
    contents = {
        "lines.csv": lines,
        "mark.csv": b"\xef\xbb\xbf" + lines,
        "two marks, no last break.csv": b"\xef\xbb\xbf\xef\xbb\xbf" + lines[:-2],
        "no last break [1] {a,b} 5%41.csv": lines + b"\xc3",
        "bytes.parquet": n.randbytes(150_000),
        "breaks.txt": b"\n" * 100_000,
        "one line.json": b'[{"a": "' + b'"}, {"a": "\xe2\x82\xac'.join([b"x" * 50] * 2000) + b'"}]',
        "a/lines.csv": lines[::-1],
        "a/b/lines.csv": lines,
        "a/b/small.csv": b"small",
        "small.csv.gz": gzip.compress(lines[:5000]),
    }
    for name, content in contents.items():
        (raw / name).write_bytes(content)
    settings = {
        "spark.sql.files.maxPartitionBytes": "20000",
        "spark.sql.files.openCostInBytes": "1000",  # ends of several files share a task
        "spark.sql.sources.binaryFile.maxLength": "40000",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = rows(S.content_hash(spark, [str(raw), str(raw / "a")], whole_bytes=30_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(
        ((f"file:{raw / name}", len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items()), key=repr
    )


def test_packed_files_are_hashed_as_they_are(spark, tmp_path, rows):
    packed = gzip.compress(random.Random(2).randbytes(5000))
    (tmp_path / "a.csv.gz").write_bytes(packed)
    got = rows(S.content_hash(spark, str(tmp_path), whole_bytes=1000), "length", "sha256")
    assert got == [(len(packed), hashlib.sha256(packed).hexdigest())]


def test_parts_are_not_shuffled(spark, tmp_path, rows, monkeypatch):
    """A part is written from columns that all tasks wrote before: exactly as many files, whatever the input's partitions."""
    df = spark.range(1000).selectExpr("id", "id % 7 AS _v", "CAST(NULL AS STRING) AS s").union(spark.range(5).selectExpr("0", "0", "'x'"))
    want = rows(df)
    monkeypatch.setattr(type(df), "repartition", lambda *_: pytest.fail("rows are shuffled to the parts"))
    before = spark.conf.get("spark.sql.unionOutputPartitioning", None)
    for parts in (1, 3, 5):
        path = tmp_path / str(parts)
        assert S.export_single(df, str(path), parts) == parts
        counts = [spark.read.parquet(str(f)).count() for f in path.glob("*.parquet")]
        assert len(counts) == parts and max(counts) - min(counts) <= 20
        assert rows(spark.read.parquet(str(path))) == want
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) == before


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("050760", 1), ("050760", 2), ("000001", 3)], "facility_id string, v int")
    S.write_partitioned(df, str(tmp_path / "p"))
    assert rows(S.read_parquet_many(spark, str(tmp_path / "p"), schema=df.schema), "facility_id", "v") == rows(df)
    assert S.export_single(df, str(tmp_path / "one")) == 1
    assert S.export_single(df, str(tmp_path / "many"), parts=2) == 2
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert rows(spark.read.parquet(str(tmp_path / "many"))) == rows(df)
    assert S.write_table(df, "t_clustered", cluster_by=["facility_id"], path=str(tmp_path / "t")) == (3, 2)
    spark.sql("drop table t_clustered")
    assert S.load_dimension(df, "t_dim", strings("facility_id", "v"), path=str(tmp_path / "d")) == (3, 2)
    assert dict(spark.table("t_dim").dtypes) == {"facility_id": "string", "v": "string"}
    S.create_view(df.filter("v > 1"), "late_rows")
    assert spark.sql("select count(*) from late_rows").first()[0] == 2
    spark.sql("drop table t_dim")
    S.write_parquet(df, str(tmp_path / "plain"))
    assert rows(S.read_parquet_many(spark, str(tmp_path / "plain"))) == rows(df)
    S.write_review_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    done = df.filter("v = 3")
    assert rows(S.pending_work(df, done, ["facility_id"])) == [("050760", 1), ("050760", 2)]
    status = S.batch_status(df.select("facility_id").distinct(), done, ["facility_id"])
    assert rows(status, "facility_id", "status", "error") == [("000001", "success", None), ("050760", "failed", "no rows")]


def test_landed_files_have_their_first_and_last_lines(spark):
    """Rows are computed once: what stands in front and behind goes with the first and last row of a file."""
    from ratebook.registry.files import _land

    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        passes.add(1)
        return x

    body = spark.createDataFrame([("a", i, f"a{i}") for i in (3, 1, 2)] + [("b", 5, "b5")] + [("c", 1, None), ("c", 2, None)],
                                 "file_key string, line_number long, line string").repartition(3)
    head = F.array(F.concat(F.lit("head "), "file_key"), F.lit("names"))
    path = _land(body.withColumn("line", counted("line")), "landed", head, F.when(F.col("file_key") != "b", F.lit("end")))
    text = {r["file_key"]: r["value"] for r in spark.read.text(path, wholetext=True).collect()}
    assert text == {
        "a": "head a\nnames\na1\na2\na3\nend\n", "b": "head b\nnames\nb5\n", "c": "head c\nnames\nend\n",
    }
    assert passes.value == 6


def test_partitioned_files_are_moved_by_their_tasks(spark, rows, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from ratebook.sources.sinks import write_partitioned

    options, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: (options.update({k: v}), option(self, k, v))[1])
    df = spark.createDataFrame([(str(i % 7), i) for i in range(50)], "facility_id string, v int")
    write_partitioned(df, str(tmp_path / "t"))
    assert options["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    assert rows(spark.read.schema(df.schema).parquet(str(tmp_path / "t")), "facility_id", "v") == rows(df)
