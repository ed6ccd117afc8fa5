"""Configuration files, the grids they name, and the names of files and folders."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_name, fit_folder


def read_config(path: str) -> dict:
    """A YAML or JSON file as a dictionary."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs PyYAML; JSON files need nothing") from e
        return yaml.safe_load(f)


def fit_rows(config: dict) -> list[dict]:
    """One dictionary a dataset and block model: name, path and the model's fields; the global seed where a model has none."""
    models = config["sbm"] if isinstance(config["sbm"], list) else [config["sbm"]]
    rows = [{"name": d["name"], "path": d["path"], **m} for d, m in itertools.product(config["datasets"], models)]
    for r in rows:
        if config.get("seed") is not None:
            r.setdefault("seed", config["seed"])
    return rows


def eval_row(config: dict) -> dict[str, str]:
    """The evaluation's fields as text; metrics joined by underscores."""
    return {"n_surrogates": str(config["n_surrogates"]), "metrics": "_".join(config["metrics"])}


def grid(spark: SparkSession, datasets: list[dict], models: list[dict], seed: int = 0) -> DataFrame:
    """(dataset, path, model, seed): every dataset with every model, a row each, with a seed of its own made from both by hash. The lists
    are configuration, held on the driver."""
    rows = [(d["name"], d["path"], {str(k): str(v) for k, v in m.items()}) for d, m in itertools.product(datasets, models)]
    out = spark.createDataFrame(rows, "dataset string, path string, model map<string,string>")
    return out.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "dataset", F.to_json("model")), F.lit(2**31 - 1)))


def statistics_name(dataset: str, surrogates: int, parameters: dict | None = None) -> str:
    """The file of a dataset's surrogate statistics. With parameters they are part of the name, so that runs do not meet in one file."""
    name = clean_name(f"{dataset}_surrogates_{surrogates}_")
    return (name if not parameters else fit_folder(name.rstrip("_"), parameters)) + ".csv"


def dataset_path(folder: str, dataset: str) -> str:
    return f"{folder.rstrip('/')}/{clean_name(dataset)}.npz"


def fit_path(folder: str, dataset: str, parameters: dict) -> str:
    return f"{folder.rstrip('/')}/sbm_fit_{fit_folder(dataset, parameters)}"


def block_size_in(name: Column) -> Column:
    """The number after min_block_size_ in a file name; null without one."""
    found = F.regexp_extract(name, r"min_block_size_(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def dataset_in(name: Column) -> Column:
    """What stands before _min_block_size, or before _patience, or the whole name, without folder, sbm_fit_ and extension."""
    base = F.regexp_replace(F.regexp_replace(F.substring_index(name, "/", -1), r"^sbm_fit_", ""), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_extract(base, r"^(.*?)(?:_(?:cooling_rate|force_undirected|init_method|min_block_size|patience|surrogates).*)?$", 1)


def named_with(files: DataFrame, word: str, column: str = "file") -> DataFrame:
    """The files whose name holds the word."""
    return files.where(F.contains(F.col(column), F.lit(word)))


def elapsed(seconds: Column) -> Column:
    return F.format_string("%.3f", seconds.cast("double"))


def safe(name: str) -> str:
    """A name fit for a folder."""
    return re.sub(r"\s+", "_", clean_name(name))
