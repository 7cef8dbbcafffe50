"""Parsing of structured texts; encodings, hashes, compression."""

from __future__ import annotations

import base64
import csv
import gzip
import json
import re
import shlex
import uuid
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function
from sluice.plans.expr import E, as_array, as_string

STRING, LONG, VARIANT = T.StringType(), T.LongType(), T.VariantType()


def text_udf(names: str, work, least: int = 1, most: int | None = None, result=STRING):
    """A function of texts in Arrow batches; what cannot be read gives null."""

    @function(names, least, most or least, kind="U")
    def _(ctx, args):
        @F.pandas_udf(result)
        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                try:
                    out.append(None if row[0] is None else work(*row))
                except (ValueError, UnicodeError, OSError, EOFError, zlib.error, ElementTree.ParseError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        return E(run(*[as_string(ctx, a) for a in args]), result)


def json_udf(names: str, work, least: int = 1, most: int | None = None):
    """The same with a dynamic result."""

    @function(names, least, most or least, kind="U")
    def _(ctx, args):
        @F.pandas_udf("string")
        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                try:
                    out.append(None if row[0] is None else json.dumps(work(*row)))
                except (ValueError, UnicodeError, ElementTree.ParseError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        return E(F.try_parse_json(run(*[as_string(ctx, a) for a in args])), VARIANT)


@function("base64_encode_tostring base64_encodestring", 1)
def _(ctx, args):
    return E(F.base64(F.encode(as_string(ctx, args[0]), "UTF-8")), STRING)


@function("base64_decode_tostring base64_decodestring", 1)
def _(ctx, args):
    data = F.try_to_binary(as_string(ctx, args[0]), F.lit("base64"))
    return E(F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")), STRING)


@function("base64_decode_toarray", 1)
def _(ctx, args):
    digits = F.hex(F.try_to_binary(as_string(ctx, args[0]), F.lit("base64")))
    n = F.char_length(digits) / 2
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return E(F.when(n > 0, bytes_).when(n == 0, F.array().cast("array<bigint>")), T.ArrayType(LONG))


@function("base64_encode_fromarray", 1)
def _(ctx, args):
    digits = F.array_join(F.transform(as_array(ctx, args[0]).column, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    return E(F.base64(F.unhex(digits)), STRING)


text_udf("base64_encode_fromguid", lambda s: base64.b64encode(uuid.UUID(s).bytes_le).decode())
text_udf("base64_decode_toguid", lambda s: str(uuid.UUID(bytes_le=base64.b64decode(s, validate=True))))
text_udf("gzip_compress_to_base64_string", lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode())
text_udf("gzip_decompress_from_base64_string", lambda s: gzip.decompress(base64.b64decode(s)).decode())
text_udf("zlib_compress_to_base64_string", lambda s: base64.b64encode(zlib.compress(s.encode())).decode())
text_udf("zlib_decompress_from_base64_string", lambda s: zlib.decompress(base64.b64decode(s)).decode())
text_udf("punycode_from_string", lambda s: s.encode("punycode").decode())
text_udf("punycode_to_string", lambda s: s.encode().decode("punycode"))
text_udf("punycode_domain_from_string", lambda s: ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in s.split(".")))
text_udf("punycode_domain_to_string", lambda s: ".".join(p[4:].encode().decode("punycode") if p.startswith("xn--") else p for p in s.split(".")))


@function("hash", 1, 2, kind="B")
def _(ctx, args):
    """A 64-bit hash of the text; not the value that other engines give."""
    h = F.xxhash64(as_string(ctx, args[0]))
    return E(F.pmod(h, args[1].column.cast("long")) if len(args) > 1 else h, LONG)


@function("hash_xxhash64", 1, 2, kind="B")
def _(ctx, args):
    h = F.xxhash64(as_string(ctx, args[0]))
    return E(F.pmod(h, args[1].column.cast("long")) if len(args) > 1 else h, LONG)


for _name, _build in {"hash_md5": F.md5, "hash_sha1": F.sha1, "hash_sha256": lambda c: F.sha2(c, 256)}.items():

    @function(_name, 1, kind="B")
    def _(ctx, args, build=_build):
        return E(build(F.encode(as_string(ctx, args[0]), "UTF-8")), STRING)


@function("url_encode", 1, kind="B")
def _(ctx, args):
    return E(F.url_encode(as_string(ctx, args[0])), STRING)


@function("url_encode_component", 1, kind="C")
def _(ctx, args):
    return E(F.replace(F.url_encode(as_string(ctx, args[0])), F.lit("+"), F.lit("%20")), STRING)


@function("url_decode", 1, kind="B")
def _(ctx, args):
    return E(F.try_url_decode(as_string(ctx, args[0])), STRING)


def _url_query(query):
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    keys = F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    values = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.char_length(p))).otherwise(""))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    # of a repeated key the first value stays
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(e["k"]), F.array(e["v"])))))


@function("parse_url", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    part = lambda p: F.coalesce(F.try_parse_url(text, F.lit(p)), F.lit(""))
    authority, host = part("AUTHORITY"), part("HOST")
    user = part("USERINFO")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    parts = F.struct(
        part("PROTOCOL").alias("Scheme"), host.alias("Host"), port.alias("Port"), part("PATH").alias("Path"), F.split_part(user, F.lit(":"), F.lit(1)).alias("Username"),
        F.split_part(user, F.lit(":"), F.lit(2)).alias("Password"), _url_query(F.try_parse_url(text, F.lit("QUERY"))).alias("Query Parameters"), part("REF").alias("Fragment"),
    )
    return E(F.when(text.isNotNull(), F.to_variant_object(parts)), VARIANT)


@function("parse_urlquery", 1, 2)
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(F.to_variant_object(F.struct(_url_query(F.regexp_replace(text, r"^\?", "")).alias("Query Parameters"))), VARIANT)


@function("parse_path", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    scheme = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    stream = F.regexp_extract(rest, r"^(?:[A-Za-z]:)?[^:]*:([^:\\/]+)$", 1)
    plain = F.when(stream != "", F.regexp_replace(rest, r":[^:\\/]+$", "")).otherwise(rest)
    file = F.regexp_extract(plain, r"([^\\/]*)$", 1)
    parts = F.struct(
        scheme.alias("Scheme"), F.regexp_extract(plain, r"^(/|\\\\[^\\]+|[A-Za-z]:)", 1).alias("RootPath"), F.regexp_replace(plain, r"[\\/][^\\/]*$", "").alias("DirectoryPath"),
        F.regexp_extract(plain, r"([^\\/]+)[\\/][^\\/]*$", 1).alias("DirectoryName"), file.alias("Filename"), F.regexp_extract(file, r"\.([^.]+)$", 1).alias("Extension"), stream.alias("AlternateDataStreamName"),
    )
    return E(F.when(text.isNotNull(), F.to_variant_object(parts)), VARIANT)


@function("parse_version", 1)
def _(ctx, args):
    """Up to four parts of at most eight digits as one decimal number."""
    text = as_string(ctx, args[0])
    parts = F.split(text, r"\.")
    number = lambda k: F.lpad(F.coalesce(F.get(parts, F.lit(k)), F.lit("0")), 8, "0")
    joined = F.concat(*[number(k) for k in range(4)])
    return E(F.when(text.rlike(r"^\d{1,8}(\.\d{1,8}){0,3}$"), joined.cast("decimal(38,0)")), T.DecimalType(38, 0))


def parse_csv(text: str) -> list[str]:
    return next(csv.reader([text]), []) if "\n" not in text else [x for row in csv.reader(text.splitlines()) for x in row][: len(next(csv.reader(text.splitlines())))]


@function("parse_csv", 1, kind="U")
def _(ctx, args):
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else parse_csv(x))

    return E(run(as_string(ctx, args[0])), T.ArrayType(STRING))


def command_line(text: str, kind: str = "windows") -> list[str]:
    return shlex.split(text, posix=True) if "\\" not in text else [p.strip('"') for p in shlex.split(text, posix=False)]


json_udf("parse_command_line", command_line, 1, 2)


def xml_value(node) -> object:
    out: dict = {f"@{k}": v for k, v in node.attrib.items()}
    for child in node:
        name = child.tag.rpartition("}")[2]
        value = xml_value(child)
        if name in out:
            out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        else:
            out[name] = value
    text = (node.text or "").strip()
    if not out:
        return text
    if text:
        out["#text"] = text
    return out


json_udf("parse_xml", lambda s: {(r := ElementTree.fromstring(s)).tag.rpartition("}")[2]: xml_value(r)})

_BROWSERS = (("Edge", r"Edge?/(\d+)\.(\d+)"), ("Opera", r"OPR/(\d+)\.(\d+)"), ("Firefox", r"Firefox/(\d+)\.(\d+)"), ("Chrome", r"Chrome/(\d+)\.(\d+)"), ("Safari", r"Version/(\d+)\.(\d+).*Safari"), ("IE", r"MSIE (\d+)\.(\d+)"))
_SYSTEMS = (("Windows", r"Windows NT (\d+)\.(\d+)"), ("Android", r"Android (\d+)(?:\.(\d+))?"), ("iOS", r"OS (\d+)_(\d+) like Mac"), ("Mac OS X", r"Mac OS X (\d+)[_.](\d+)"), ("Linux", r"(Linux)()"))


def user_agent(text: str, wanted: str = "") -> dict:
    out = {}
    for key, table in (("Browser", _BROWSERS), ("OperatingSystem", _SYSTEMS)):
        hit = next(((n, m) for n, p in table if (m := re.search(p, text))), None)
        out[key] = {"Family": hit[0] if hit else "Other", "MajorVersion": (hit[1][1] if hit and hit[1][1].isdigit() else ""), "MinorVersion": (hit[1][2] or "") if hit else ""}
    device = re.search(r"\((iPhone|iPad|Macintosh)|; ([^;)]+) Build/", text)
    out["Device"] = {"Family": next((g for g in device.groups() if g), "Other") if device else "Other", "Brand": "Apple" if device and device[1] else "", "Model": (device[1] or device[2]) if device else ""}
    wanted_keys = {"browser": "Browser", "os": "OperatingSystem", "device": "Device"}
    return {k: v for k, v in out.items() if not wanted or any(name in wanted.lower() and k == key for name, key in wanted_keys.items())}


json_udf("parse_user_agent", user_agent, 1, 2)
