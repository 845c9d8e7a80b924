"""Answers of network cameras: XML whose elements are found by their local names, whatever their prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_prefixes(xml: Column) -> Column:
    """XML without namespaces and comments; null where it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"""\s+xmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')""", "")
    plain = F.regexp_replace(plain, r"(</?)[A-Za-z_][\w.-]*:", "$1")
    return F.regexp_replace(plain, r"(\s)[A-Za-z_][\w.-]*:([A-Za-z_][\w.-]*\s*=)", "$1$2")


def elements(documents: DataFrame, key: list[str], xml: str, name: str) -> DataFrame:
    """(key, index, element): every element of a name, as XML of its own. Elements of the name inside each other count as one."""
    pattern = rf"(?s)<{name}(?:\s[^>]*)?(?:/>|>.*?</{name}>)"
    found = F.regexp_extract_all(without_prefixes(F.col(xml)), F.lit(pattern), F.lit(0))
    return documents.select(*key, F.posexplode(found).alias("index", "element"))


def value(element: Column, *path: str) -> Column:
    """The text of the first element below with these names; null if there is none or it is empty."""
    text = F.trim(F.xpath_string(element, F.lit("(//" + "//".join(path) + ")[1]")))
    return F.when(text != "", text)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def devices(documents: DataFrame, key: list[str], xml: str) -> DataFrame:
    """Cameras that answered a probe: address, types, scopes and service addresses."""
    e = F.col("element")
    return elements(documents, key, xml, "ProbeMatch").select(
        *key, "index", value(e, "Address").alias("address"), words(value(e, "Types")).alias("types"), words(value(e, "Scopes")).alias("scopes"),
        words(value(e, "XAddrs")).alias("xaddrs"), value(e, "MetadataVersion").alias("metadata_version"),
    )


def services(documents: DataFrame, key: list[str], xml: str) -> DataFrame:
    """Services with their namespace, address and version; problem where one of the first two is missing."""
    e = F.col("element")
    version = F.concat_ws(".", value(e, "Version", "Major"), value(e, "Version", "Minor"))
    rows = elements(documents, key, xml, "Service").select(
        *key, "index", value(e, "Namespace").alias("namespace"), value(e, "XAddr").alias("xaddr"), F.when(version != "", version).alias("version")
    )
    return rows.withColumn("problem", F.when(F.col("namespace").isNull(), "no namespace").when(F.col("xaddr").isNull(), "no address"))


def profiles(documents: DataFrame, key: list[str], xml: str) -> DataFrame:
    """Media profiles: token, name, video source and encodings; problem where the token is missing."""
    e = F.col("element")
    token = F.trim(F.xpath_string(e, F.lit("/Profiles/@token")))
    of = lambda part, leaf: F.coalesce(value(e, part + "Configuration", leaf), value(e, part, leaf))
    return elements(documents, key, xml, "Profiles").select(
        *key, "index", F.when(token != "", token).alias("token"), value(e, "Name").alias("name"), of("VideoSource", "SourceToken").alias("video_source"),
        of("VideoEncoder", "Encoding").alias("video_encoding"), of("AudioEncoder", "Encoding").alias("audio_encoding"), F.when(token == "", "no token").alias("problem"),
    )


def device_information(documents: DataFrame, key: list[str], xml: str) -> DataFrame:
    plain = without_prefixes(F.col(xml))
    names = {"manufacturer": "Manufacturer", "model": "Model", "firmware": "FirmwareVersion", "serial": "SerialNumber", "hardware": "HardwareId"}
    return documents.select(*key, *[value(plain, leaf).alias(name) for name, leaf in names.items()])
