"""Files that corpora come from and go to: staged records, fingerprints, pages, archives, profiles."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schema as s
from foliospark.functions import text as t

#: Fixed value: a line of a fingerprint file; the last two spaces part locator and hash.
FINGERPRINT_LINE = r"^(.+)  ([0-9a-f]{64})$"


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Records of a staged corpus, one JSON object a line; blank lines are skipped, unknown fields are not read, broken lines stop the read."""
    return spark.read.schema(s.STAGED).option("mode", "FAILFAST").json(path)


def write_staged(records: DataFrame, path: str) -> str:
    """Write records under a new version of ``path`` and then point ``path``/CURRENT at it: readers see the old version or the new one."""
    version = f"v-{uuid.uuid4().hex}"
    records.write.json(f"{path}/{version}")
    spark = records.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}")
    out = fs.create(temporary, True)
    out.write(bytearray(version.encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(target), how)  # in one step: there is always a CURRENT
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return read_staged(spark, f"{path}/{version}")


def parse_fingerprints(files: DataFrame) -> DataFrame:
    """corpus_id, locator, sha256, problem of each line of fingerprint files (corpus_id, value): a problem is a bad line or a locator that comes twice."""
    rows = files.filter(F.col("value") != "").select("corpus_id", "value", F.regexp_extract("value", FINGERPRINT_LINE, 1).alias("locator"), F.regexp_extract("value", FINGERPRINT_LINE, 2).alias("sha256"))
    n = rows.filter("locator <> ''").groupBy("corpus_id", "locator").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    problem = F.when(F.col("locator") == "", "malformed").when(F.col("n").isNotNull(), "duplicate").otherwise("")
    return rows.join(n, ["corpus_id", "locator"], "left").select("corpus_id", "locator", "sha256", problem.alias("problem"))


def render_fingerprints(records: DataFrame) -> DataFrame:
    """corpus_id, locator, value: lines of fingerprint files, in bytewise order of locators."""
    return records.select("corpus_id", "locator", F.concat_ws("  ", "locator", "content_hash").alias("value")).orderBy("corpus_id", "locator")


def page_links(pages: DataFrame, pattern: str = r'<a\s[^>]*href="([^"]+)"') -> DataFrame:
    """page_id, pos, link: targets of a page's links in order, each at its first place."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "link"))


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """path, member, text of the archives' members whose names end in ``suffix``; archives are read in parallel, members in turn."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for member in sorted(archive.namelist()):
                        if member.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([archive.read(member).decode("utf-8", "replace")])], names=["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, text string")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """name, hash, intact: content-addressed blobs, and whether each still hashes to its own name."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select(name.alias("name"), F.sha2("content", 256).alias("hash"), (F.sha2("content", 256) == name).alias("intact"))


def staged_ids(spark: SparkSession, path: str) -> list[str]:
    """Names of the corpora that are staged under ``path``, sorted: folders with a version that counts, whatever is registered."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/CURRENT")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(x.getPath().getParent().getName() for x in found or ())


def _yaml(text: str):
    import yaml  # not everywhere: only what reads such files needs it

    return yaml.safe_load(text)


# A manifest's fields; no others are allowed.
_STRINGS = ("corpus_id", "source_url", "archive_url", "retrieved", "upstream_sha256", "license", "license_terms", "attribution")
_INTEGERS = ("normalisation_version", "chunk_count")
_CHECK = ("diagnostic", "expected_sha256", "verified_by", "verified")
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_SHAPES = {"corpus_id": t.CORPUS_ID, "upstream_sha256": t.SHA256, "retrieved": _DATE, "edition_check.expected_sha256": t.SHA256, "edition_check.verified": _DATE}


def manifest_problems(manifest: dict) -> list[str]:
    """What is wrong with a corpus manifest, a small file read on the driver; unknown keys are wrong too."""
    if not isinstance(manifest, dict):
        return ["not a mapping"]
    check = manifest.get("edition_check")
    flat = {k: v for k, v in manifest.items() if k != "edition_check"} | ({f"edition_check.{k}": v for k, v in check.items()} if isinstance(check, dict) else {})
    strings = [*_STRINGS, *(f"edition_check.{k}" for k in _CHECK)]
    found = [f"missing {k}" for k in (*strings, *_INTEGERS) if k not in flat]
    found += [f"unknown {k}" for k in flat if k not in strings and k not in _INTEGERS]
    found += [f"empty {k}" for k in strings if k in flat and not (isinstance(flat[k], str) and flat[k].strip())]
    found += [f"malformed {k}" for k in _INTEGERS if k in flat and not (type(flat[k]) is int and flat[k] > 0)]
    found += [f"malformed {k}" for k, shape in _SHAPES.items() if isinstance(flat.get(k), str) and flat[k].strip() and not re.search(shape, flat[k])]
    return found + (["unknown licence"] if flat.get("license") and flat["license"] not in s.LICENSES else [])


def read_manifest(text: str) -> dict:
    """A manifest from its YAML text; dates may be written bare. What is wrong with it is an error."""
    raw = _yaml(text)
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x.isoformat() if hasattr(x, "isoformat") else x
    if problems := manifest_problems(manifest := plain(raw)):
        raise ValueError("; ".join(problems))
    return manifest


# A profile's fields, by where they are.
_PROFILE = {"": {"profile", "scripture", "corpora", "contested"}, "scripture": {"corpus_id", "stance"}, "corpora": {"id", "stance", "note", "label"}, "contested": {"locus", "ruling_source"}, "ruling_source": {"corpus_id", "locator"}}


def read_profile(text: str) -> dict:
    """A profile from its YAML text; a key that profiles don't have is an error, and scripture without a stance is binding."""
    raw = _yaml(text) or {}
    parts = [("", raw), ("scripture", raw.get("scripture") or {}), *(("corpora", c) for c in raw.get("corpora") or []), *(("contested", c) for c in raw.get("contested") or [])]
    parts += [("ruling_source", c.get("ruling_source") or {}) for c in raw.get("contested") or []]
    if odd := [f"{where}.{k}".lstrip(".") for where, part in parts for k in part if k not in _PROFILE[where]]:
        raise ValueError(f"unknown {', '.join(odd)}")
    scripture = {"stance": "binding"} | {k: v for k, v in (raw.get("scripture") or {}).items() if v}
    return raw | {"scripture": scripture}


def bless(spark: SparkSession, records: DataFrame, manifest: dict, path: str) -> None:
    """Write a corpus's fingerprints and then its manifest under ``path``; what a manifest must hold is checked before anything is written."""
    held = records.filter(F.col("corpus_id") == manifest.get("corpus_id", ""))
    problems = manifest_problems(manifest)
    if not problems and held.count() != manifest["chunk_count"]:
        problems = ["chunk_count is not the number of records"]
    if not problems:
        check = manifest["edition_check"]
        if held.filter((F.col("locator") == check["diagnostic"]) & (F.col("content_hash") == check["expected_sha256"])).isEmpty():
            problems = ["the diagnostic record does not hash to what was read"]
    if problems:
        raise ValueError("; ".join(problems))
    render_fingerprints(held).select("value").write.mode("overwrite").text(f"{path}/{manifest['corpus_id']}/fingerprints")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{manifest['corpus_id']}/manifest")


def answer_fields(kind: T.DataType = s.ANSWER) -> dict[str, bool]:
    """Structs of an answer by their fields' names, and whether they only ever come in lists."""
    seen: dict[str, bool] = {}

    def walk(x: T.DataType, listed: bool):
        if isinstance(x, T.ArrayType):
            walk(x.elementType, True)
        elif isinstance(x, T.StructType):
            name = ",".join(x.names)
            seen[name] = seen.get(name, True) and listed
            for f in x:
                walk(f.dataType, False)

    walk(kind, False)
    return seen


def answer_json_schema() -> str:
    """JSON Schema of an answer object, from its struct: nothing else is allowed, and confidence is not the model's to give.

    Objects that only come in lists need all their fields, since an empty one would count; others need none.
    Tiers are a closed domain.
    """
    listed = answer_fields()

    def of(kind: T.DataType, name: str) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType, "")}
        if isinstance(kind, T.StructType):
            fields = {f.name: of(f.dataType, f.name) for f in kind if f.name != "confidence"}
            return {"type": "object", "properties": fields, "required": list(fields) if listed[",".join(kind.names)] else [], "additionalProperties": False}
        if name == "tier":
            return {"type": "string", "enum": ["TIER_UNSPECIFIED", *(f"TIER_{x.upper()}" for x in s.TIERS)]}
        return {"type": "boolean" if isinstance(kind, T.BooleanType) else "string"}

    return json.dumps(of(s.ANSWER, ""))
