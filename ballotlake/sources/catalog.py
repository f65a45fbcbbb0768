"""Schemas, datasets, tables by name, raw files, downloads and sinks."""

from __future__ import annotations

import json
import os
import shutil
import urllib.error
import urllib.request
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_PERIODS = "array<struct<debut:string,fin:string>>"

#: The declared schemas of the published tables. None is ever inferred.
SCHEMAS = {
    "organes": "organe_uid string, code_type string, libelle string, libelle_abrege string, libelle_abrev string, date_debut string, date_fin string, legislature string, position_politique string",
    "mandats": "mandat_uid string, acteur_uid string, type_organe string, organe_uid string, legislature string, date_debut string, date_prise_fonction string, date_fin string, qualite string, departement string, num_departement string, num_circo string, region string",
    "acteurs": "acteur_uid string, civilite string, prenom string, nom string, date_naissance string, date_deces string, profession string, cat_socio_pro string, uri_hatvp string",
    "deputes": f"acteur_uid string, civilite string, prenom string, nom string, date_naissance string, date_deces string, profession string, cat_socio_pro string, uri_hatvp string, periodes_mandat {_PERIODS}, mandat_interrompu boolean, interruptions {_PERIODS}, mandat_debut string, mandat_fin string, departement string, num_departement string, num_circo string, region string, groupe_uid string, groupe_qualite string, nb_groupes_legislature bigint, groupe_libelle string, groupe string, groupe_position string, nom_complet string, en_exercice boolean, mandat_debut_d date, mandat_fin_d date",
    "scrutins": "scrutin_uid string, numero bigint, date string, legislature string, type_vote_code string, type_vote_libelle string, sort_code string, sort_libelle string, titre string, demandeur string, dossier_uid string, dossier_titre string, seance_uid string, mode_publication string, nb_votants bigint, suffrages_exprimes bigint, suffrages_requis bigint, n_pour bigint, n_contre bigint, n_abstention bigint, n_non_votant bigint, date_d date, categorie string, portee string, contestation double",
    "votes": "scrutin_uid string, acteur_uid string, groupe_uid string, position string, position_majoritaire_groupe string, par_delegation boolean, cause string",
    "positions_groupe": "scrutin_uid string, groupe_uid string, n_pour bigint, n_contre bigint, n_abstention bigint, votants_groupe bigint, n_majoritaire bigint, partage boolean, majoritaire string, part_majoritaire double",
    "amendements": "amendement_uid string, numero string, texte_legislatif_uid string, dossier_uid string, legislature string, date_depot string, date_sort string, etat string, sort string, auteur_uid string, auteur_groupe_uid string, auteur_type string, auteur_rapporteur boolean, nb_cosignataires bigint, cosignataires array<string>, division_titre string, division_article string, dispositif string, expose_sommaire string, date_depot_d date",
}
OPTIONAL = ("amendements",)


def schema(name: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[name])


class Catalog:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"{self.path(name)}: build the tables first")
        reader = self.spark.read.schema(schema(name)) if name in SCHEMAS else self.spark.read
        return reader.parquet(self.path(name))

    def optional(self, name: str) -> DataFrame | None:
        """None switches the features that need the table off."""
        return self.load(name) if self.has(name) else None

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Under a declared schema the columns are put in its order; missing ones are null."""
        if name in SCHEMAS:
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(name))

    def build_all(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            self.write(name, df)


def info(tables: dict[str, DataFrame], span: dict[str, str]) -> DataFrame:
    """(nom_table, n_lignes, n_colonnes, premier, dernier): one row per table; ``span``: its day column, if it has one."""
    parts = []
    for name, df in tables.items():
        day = F.col(span[name]) if name in span else F.lit(None).cast("date")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_lignes"), F.min(day).alias("premier"), F.max(day).alias("dernier")).select(F.lit(name).alias("nom_table"), "n_lignes", F.lit(len(df.columns)).cast("bigint").alias("n_colonnes"), "premier", "dernier"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_documents(spark: SparkSession, folder: str, glob: str = "*.json", part: str | None = None, depth: int = 8) -> DataFrame:
    """(chemin, contenu, dossier_uid): one row per file at any depth, or below the folders named ``part`` up to ``depth`` levels down; the bill file is the nearest folder named like one.

    Only the folders asked for are listed; none of that name is an empty result.
    """
    where = [folder]
    if part:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [path("/".join([folder, *["*"] * k, part])) for k in range(depth)]
        where = [str(s.getPath()) for p in found for s in (p.getFileSystem(conf).globStatus(p) or []) if s.isDirectory()]
        if not where:
            return spark.createDataFrame([], "chemin string, contenu string, dossier_uid string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(where)
    d = files.select(F.col("path").alias("chemin"), F.decode("content", "UTF-8").alias("contenu"))
    return d.withColumn("dossier_uid", bill_of_path(F.col("chemin")))


def bill_of_path(path):
    return F.nullif(F.regexp_extract(path, r"^.*/(DLR\w+)/[^/]*(?:/[^/]*)*$", 1), F.lit(""))


@dataclass(frozen=True)
class Dataset:
    key: str
    url: str
    folder: str


def datasets(base: str, legislature: str = "17") -> dict[str, Dataset]:
    """The three zipped JSON datasets under a base address."""
    names = {"scrutins": "loi/scrutins/Scrutins.json.zip", "acteurs": "amo/deputes_actifs_mandats_actifs_organes/AMO.json.zip", "amendements": "loi/amendements_div_legis/Amendements.json.zip"}
    return {k: Dataset(k, f"{base.rstrip('/')}/{legislature}/{v}", k) for k, v in names.items()}


class Downloader:
    """Conditional downloads with a JSON state beside the files; runs on the driver and needs no Spark."""

    def __init__(self, root: str, timeout: float = 60.0):
        self.root, self.timeout = Path(root), timeout
        self.root.mkdir(parents=True, exist_ok=True)
        self.file = self.root / "state.json"

    def state(self) -> dict:
        return json.loads(self.file.read_text()) if self.file.exists() else {}

    def fetch_one(self, d: Dataset, force: bool = False) -> bool:
        """True if a new version came and was unpacked; a partial download never replaces a whole one."""
        state, target = self.state(), self.root / f"{d.key}.zip"
        request = urllib.request.Request(d.url)
        if not force and target.exists() and state.get(d.key, {}).get("last_modified"):
            request.add_header("If-Modified-Since", state[d.key]["last_modified"])
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                stamp = {"last_modified": r.headers.get("Last-Modified"), "etag": r.headers.get("ETag")}
                if not force and target.exists() and stamp["last_modified"] and stamp == state.get(d.key):
                    return False
                part = target.with_suffix(".part")
                with part.open("wb") as f:
                    shutil.copyfileobj(r, f, 1 << 20)
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return False
            raise
        os.replace(part, target)
        with zipfile.ZipFile(target) as z:
            z.extractall(self.root / d.folder)
        self.file.write_text(json.dumps(state | {d.key: stamp}))
        return True

    def fetch_all(self, known: dict[str, Dataset], keys: list[str] | None = None, force: bool = False) -> dict[str, bool]:
        missing = set(keys or known) - set(known)
        if missing:
            raise KeyError(f"unknown datasets: {', '.join(sorted(missing))}")
        return {k: self.fetch_one(known[k], force) for k in (keys or known)}


    def fetch_images(self, uids: list[str], address: str, folder: str = "portraits", threads: int = 8) -> dict[str, int]:
        """Conditional download of one image per uid (``address`` has {uid}) by a few threads; counts of new, changed, unchanged, removed and absent ones."""
        from concurrent.futures import ThreadPoolExecutor

        target, state = self.root / folder, self.state()
        target.mkdir(exist_ok=True)
        stamps = state.get(folder, {})

        def one(uid: str) -> tuple[str, str, str | None]:
            file = target / f"{uid}.jpg"
            request = urllib.request.Request(address.format(uid=uid))
            if file.exists() and stamps.get(uid):
                request.add_header("If-Modified-Since", stamps[uid])
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    data, stamp = r.read(), r.headers.get("Last-Modified")
            except urllib.error.HTTPError as e:
                if e.code == 304:
                    return uid, "unchanged", stamps.get(uid)
                if e.code != 404:
                    raise
                data = None
            except urllib.error.URLError as e:
                if not isinstance(e.reason, FileNotFoundError):
                    raise
                data = None
            if data is None:
                gone = file.exists()
                file.unlink(missing_ok=True)
                return uid, "removed" if gone else "absent", None
            was = file.read_bytes() if file.exists() else None
            if was != data:
                part = file.with_suffix(".part")
                part.write_bytes(data)
                os.replace(part, file)
            return uid, "new" if was is None else "unchanged" if was == data else "changed", stamp

        with ThreadPoolExecutor(threads) as pool:
            done = list(pool.map(one, uids))
        self.file.write_text(json.dumps(state | {folder: {u: s for u, _, s in done if s}}))
        return {k: sum(x == k for _, x, _ in done) for k in ("new", "changed", "unchanged", "removed", "absent")}


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The stored images as a table."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)


def json_index(df: DataFrame, path: str) -> None:
    """A table as JSON lines: the search indexes of a site."""
    df.write.mode("overwrite").json(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    fix = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df
