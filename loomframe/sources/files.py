"""Files: csv with a lattice of types, Matrix Market, HDF5 (with h5py); gzip by Spark, zip and tar unpacked by the driver."""

from __future__ import annotations

import csv
import os
import tarfile
import tempfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.config import settings
from loomframe.exceptions import FileFormatException, ImproperObjectAction, InvalidArgumentValue, PackageException
from loomframe.plans.frame import PID, PNAME, Frame, no_nan, ranked, session
from loomframe.sources.memory import DEFAULT_MISSING, data


def _local(path: str) -> str:
    if path.startswith(("http://", "https://")):
        raise InvalidArgumentValue("there is no network here; fetch the file and give its path")
    return os.path.abspath(path)


def fetchFiles(source, overwrite: bool = False) -> list[str]:
    """Local paths of files; archives are unpacked into a folder of their own (see `unpack`)."""
    path = _local(str(source))
    if os.path.isdir(path):
        return sorted(os.path.join(path, p) for p in os.listdir(path))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if zipfile.is_zipfile(path) or tarfile.is_tarfile(path):
        return unpack(path)
    return [path]


def unpack(path: str) -> list[str]:
    """Unpacks where the setting fetch.location says; unset, into a temporary folder of a local session, and beside
    the archive otherwise, since executors read the files."""
    beside = None if session().sparkContext.master.startswith("local") else os.path.dirname(path)
    to = tempfile.mkdtemp(dir=settings.get("fetch", "location") or beside)
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            z.extractall(to)
    else:
        with tarfile.open(path) as t:
            t.extractall(to, filter="data")
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(to) for f in fs)


def _first_lines(path: str, n: int = 40) -> list[str]:
    """Leading lines, read by Spark so that any file system serves."""
    return [r[0] for r in session().read.text(path).limit(n).collect()]


def read(source: str, pointNames, featureNames, name, convertToType, keepPoints, keepFeatures, treatAsMissing, replaceMissingWith, rowsArePoints, ignoreNonNumericalFeatures, inputSeparator) -> Frame:
    path = source if "://" in source and not source.startswith("http") else _local(source)
    if "://" not in path and (zipfile.is_zipfile(path) or not path.endswith(".gz") and os.path.isfile(path) and tarfile.is_tarfile(path)):
        found = unpack(path)
        if len(found) != 1:
            raise FileFormatException(f"an archive of one file is needed, not of {len(found)}")
        path = found[0]
    kind = os.path.splitext(path.removesuffix(".gz"))[1].lower()
    if kind == ".parquet":
        out = Frame.from_spark(session().read.parquet(path), name=name, path=path)
    else:
        head = _first_lines(path) if kind not in (".hdf5", ".h5") else []
        if kind == ".mtx" or kind != ".csv" and head and head[0].startswith("%%MatrixMarket"):
            out = read_mtx(path, head, name)
        elif kind in (".hdf5", ".h5"):
            out = read_hdf5(path, name)
        else:
            return read_csv(path, head, pointNames, featureNames, name, convertToType, keepPoints, keepFeatures, treatAsMissing, replaceMissingWith, rowsArePoints, ignoreNonNumericalFeatures, inputSeparator)
    return _kept(out, keepPoints, keepFeatures, rowsArePoints, ignoreNonNumericalFeatures)


def _kept(out: Frame, keepPoints, keepFeatures, rowsArePoints, numbers_only) -> Frame:
    from loomframe.functions.statistics import is_numeric

    if not rowsArePoints:
        out = out.T
    if numbers_only:
        out = out._select([i for i, t in enumerate(out._types) if is_numeric(t)])
    if keepFeatures != "all":
        out = out._select(out._feature_indices(keepFeatures))
    if keepPoints != "all":
        out = out._pick(out._point_ids(keepPoints))
    return out


def _separator(line: str, given) -> str:
    if given != "automatic":
        return given
    try:
        return csv.Sniffer().sniff(line, delimiters=",;\t| ").delimiter
    except csv.Error:
        return ","


def _is_number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def read_csv(path, head, pointNames, featureNames, name, convertToType, keepPoints, keepFeatures, treatAsMissing, replaceMissingWith, rowsArePoints, numbers_only, inputSeparator) -> Frame:
    """Every column is read as text, and its type is the least of boolean, integer, number and text that all its values have."""
    at = next((i for i, line in enumerate(head) if line.strip() and not line.startswith("#")), None)
    if at is None:
        raise FileFormatException(f"{path}: nothing to read")
    sep = _separator(head[at], inputSeparator)
    split = lambda line: next(csv.reader([line], delimiter=sep))
    first = split(head[at])
    second = split(head[at + 1]) if len(head) > at + 1 else None
    header = featureNames is True or featureNames == "automatic" and (all(not _is_number(v) for v in first if v) and len(set(first)) == len(first) and second is not None and any(map(_is_number, second)) or first[0] == "pointNames")
    lines = session().read.text(path).select(F.monotonically_increasing_id().alias(PID), "value").filter("trim(value) <> ''")
    # comments and the header are the leading lines, which one partition has
    lead = F.col("value").startswith("#")
    lines = lines.filter(~lead)
    if header:
        lines = lines.filter(F.col(PID) != lines.agg(F.min(PID)).first()[0])
    width = len(first)
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    parsed = lines.select(PID, "value", F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE", "escape": '"'}).alias("r"))
    ragged = parsed.filter(F.col("r")[f"c{width}"].isNotNull() | (F.size(F.split("value", "\\" + sep)) < width)).limit(1).collect()
    if ragged:
        raise FileFormatException(f"{path}: a line has not {width} values: {ragged[0]['value']!r}")
    wide = parsed.select(PID, *[F.trim(F.col(f"r.c{i}")).alias(f"f{i}") for i in range(width)])
    gone = [m for m in treatAsMissing if isinstance(m, str)]
    cols = {f"f{i}": F.when(F.col(f"f{i}").isin("", *gone) if "" in gone else F.col(f"f{i}").isin(*gone) if gone else F.lit(False), None).otherwise(F.col(f"f{i}")) for i in range(width)}
    wide = wide.withColumns(cols)
    wide, kinds = typed(wide, [f"f{i}" for i in range(width)])
    names = [v.strip() or None for v in first] if header else [None] * width
    if isinstance(featureNames, (list, tuple)):
        names = list(featureNames)
    take_names = pointNames is True or header and first[0] in ("pointNames",)
    if header and not first[0].strip() and pointNames == "automatic":  # a nameless first column names points, unless a value comes twice
        take_names = wide.groupBy("f0").count().filter("count > 1").isEmpty()
    if header and not (first[-1].strip()) and kinds[-1] == "empty":
        width -= 1
        names = names[:-1]
    begin = int(take_names)
    pname = [F.col("f0").cast("string").alias(PNAME)] if take_names else []
    df = wide.select(PID, *pname, *[F.col(f"f{i}").alias(f"f{i - begin}") for i in range(begin, width)])
    out = Frame(no_nan(df, [f"f{i}" for i in range(width - begin)]), names[begin:], False, name, path if "://" in path else os.path.abspath(path))
    if isinstance(pointNames, (list, tuple)):
        out.points.setNames(list(pointNames))
    if replaceMissingWith is not None and replaceMissingWith == replaceMissingWith:
        from loomframe.functions.match import missing

        out.features.fillMatching(replaceMissingWith, missing)
    if convertToType is not None:
        spark_kind = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}
        for i, k in ({out._feature_index(k): v for k, v in convertToType.items()} if isinstance(convertToType, dict) else dict(enumerate(convertToType if isinstance(convertToType, list) else [convertToType] * len(out._names)))).items():
            if k is not None:
                n = k if isinstance(k, str) else k.__name__
                c = F.to_timestamp(F.col(f"f{i}")) if "datetime" in n else F.col(f"f{i}").cast(spark_kind.get(n, n))
                out._df = out._df.withColumn(f"f{i}", c)
    return _kept(out, keepPoints, keepFeatures, rowsArePoints, numbers_only)


def typed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Text columns cast to the least type of the lattice that holds them all, by one aggregation."""
    rank = lambda c: F.when(c.isNull(), 0).when(c.isin("True", "False"), 1).when(c.rlike(r"^[+-]?[0-9]{1,18}$"), 2).when(c.try_cast("double").isNotNull() & ~c.rlike("[dDfF]$"), 3).otherwise(4)
    found = df.agg(*[F.max(rank(F.col(c))).alias(c) for c in columns], *[F.min(F.when(F.col(c).isNotNull(), rank(F.col(c)))).alias(f"low_{c}") for c in columns]).first()
    new, kinds = {}, []
    for c in columns:
        top, low = found[c], found[f"low_{c}"]
        kind = "empty" if not top else "boolean" if top == 1 else "string" if top == 4 or low == 1 else "long" if top == 2 else "double"
        kinds.append(kind)
        new[c] = F.col(c).cast("double" if kind == "empty" else kind)
    return df.withColumns(new), kinds


def read_mtx(path: str, head: list[str], name) -> Frame:
    """Matrix Market: coordinates or an array, read as lines by Spark and pivoted by the columns of the matrix."""
    field = head[0].split()
    size = next(line for line in head if not line.startswith("%") and line.strip()).split()
    n, p = int(size[0]), int(size[1])
    parts = F.split(F.trim("value"), r"\s+")
    body = session().read.text(path).select(F.monotonically_increasing_id().alias("k"), "value").filter("value not like '\\%%' and trim(value) <> ''")
    body = body.filter(F.col("k") != body.agg(F.min("k")).first()[0])
    if field[2] == "coordinate":
        value = F.lit(1.0) if field[3] == "pattern" else parts[2].cast("double")
        cells = body.select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("int") - 1).alias("j"), value.alias("v"))
        if len(field) > 4 and field[4] in ("symmetric", "skew-symmetric"):
            sign = -1.0 if field[4].startswith("skew") else 1.0
            cells = cells.unionByName(cells.filter("i <> j").select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), (F.col("v") * sign).alias("v")))
    else:
        count = body.count()
        at = ranked(body, [F.col("k")], "r", count)
        cells = at.select((F.col("r") % n).alias("i"), F.floor(F.col("r") / n).cast("int").alias("j"), parts[0].cast("double").alias("v"))
    wide = session().range(n).withColumnRenamed("id", PID).join(cells, F.col(PID) == F.col("i"), "left").groupBy(PID).agg(*[F.coalesce(F.sum(F.when(F.col("j") == j, F.col("v"))), F.lit(0.0)).alias(f"f{j}") for j in range(p)])
    return Frame(wide, [None] * p, True, name, path, n)


def read_hdf5(path: str, name) -> Frame:
    try:
        import h5py
    except ImportError as e:
        raise PackageException("h5py is needed to read HDF5") from e
    with h5py.File(path) as f:
        return data(next(iter(f.values()))[()].tolist(), name=name)


def save(frame: Frame, outPath: str, fileFormat: str | None, includeNames: bool) -> None:
    """csv and parquet as folders written by all tasks, with a suffix `.csv` of one file where the table is small; mtx and hdf5 by the driver."""
    n, p = frame.shape
    if not n or not p:
        raise ImproperObjectAction("a table without points or features cannot be saved")
    kind = (fileFormat or os.path.splitext(outPath)[1].lstrip(".") or "csv").lower()
    if frame._dims and len(frame._dims) > 2 and kind not in ("hdf5", "h5"):
        raise ImproperObjectAction("only hdf5 holds more than two dimensions")
    if kind == "parquet":
        return frame.to_spark().write.mode("overwrite").parquet(outPath)
    if kind == "csv":
        rows = frame.to_spark()
        if not includeNames:
            rows = rows.drop("pointNames")
        ordered = frame._ordered()
        cols = ([F.col(PNAME).alias("pointNames")] if frame._named and includeNames else []) + [F.col(c).alias(x if x is not None else f"_c{i}") for i, (c, x) in enumerate(zip(frame._cols, frame._names, strict=True))]
        header = includeNames and any(x is not None for x in frame._names)
        out = ordered.select(*cols)
        if n * p > 10_000_000:
            return out.write.mode("overwrite").option("header", header).csv(outPath)
        # lines come to the driver a partition at a time: executors may not see its disk
        with open(outPath, "w", encoding="utf-8", newline="") as f:
            if header:
                csv.writer(f, lineterminator="\n").writerow(out.columns)
            for r in out.select(F.to_csv(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in out.columns])).alias("line")).toLocalIterator():
                f.write(r["line"] + "\n")
        return None
    if kind == "mtx":
        cells = [(i + 1, j + 1, float(v)) for i, r in enumerate(frame._rows_list()) for j, v in enumerate(r) if v]
        with open(outPath, "w") as f:
            f.write("%%MatrixMarket matrix coordinate real general\n")
            f.write(f"{n} {p} {len(cells)}\n")
            f.writelines(f"{i} {j} {v!r}\n" for i, j, v in cells)
        return None
    if kind in ("hdf5", "h5"):
        try:
            import h5py
        except ImportError as e:
            raise PackageException("h5py is needed to write HDF5") from e
        with h5py.File(outPath, "w") as f:
            f["data"] = frame.copy("numpyarray").reshape(frame.dimensions)
        return None
    raise InvalidArgumentValue(f"cannot save as {kind!r}: csv, parquet, mtx and hdf5 can be written")


__all__ = ["DEFAULT_MISSING", "fetchFiles", "read", "save"]
