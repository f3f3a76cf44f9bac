"""All scans that look at one file at a time, in one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.code_scan import with_code_hits
from palisade.operators.datastores import with_value_hits
from palisade.operators.env_scan import TEMPLATE_FILES, VAULT_FILES
from palisade.operators.probes import with_table_names
from palisade.rules.profiles import DATASTORE_NAMES, ENV, ENV_VALUES, SCHEMA
from palisade.rules.stacks import PROJECT_FILES
from palisade.sources.files import in_profile, with_name_parts
from palisade.sources.shared import write_once

#: small files whose contents several scans read line by line
_BY_PATH = (".gitignore", "composer.json", "package.json", "pyproject.toml", "requirements.txt", *TEMPLATE_FILES, *VAULT_FILES, *PROJECT_FILES)


def is_small() -> Column:
    """Environment files, schemas and manifests."""
    small = F.col("path").isin(*sorted(set(_BY_PATH)))
    for profile in (ENV, ENV_VALUES, DATASTORE_NAMES, SCHEMA):
        small = small | in_profile(profile)
    return small


def shared_scan(files: DataFrame) -> DataFrame:
    """The files with what the scans found in them: ``code_hits``, ``value_hits``, ``table_names``, and ``content`` of small files only.

    Every scan takes this table in place of the files, and takes the columns in place of looking again. It is written once: contents are
    read once, and what is read later is the small files and the findings. A file's row is one row here, so a project that owns
    most files is spread like any other.
    """
    found = with_table_names(with_value_hits(with_code_hits(with_name_parts(files))))
    return write_once(found.select(
        "project_id", "path", "name", "ext", F.when(is_small(), F.col("content")).alias("content"), "code_hits", "value_hits", "table_names"), "files")
