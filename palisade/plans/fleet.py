"""The whole analysis of a fleet of projects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from palisade.operators.code_scan import code_findings
from palisade.operators.credentials import credential_dedup, credential_inventory
from palisade.operators.datastores import client_key_exposure, datastore_hints, datastore_list, datastore_profile
from palisade.operators.env_scan import env_findings, env_values, last_env_value, missing_env_template, vault_files
from palisade.operators.http_posture import header_findings
from palisade.operators.leaks import hardcoded_env_values
from palisade.operators.probes import open_table_findings, table_references, tables_to_probe
from palisade.operators.repo import commit_findings, ignore_coverage, tracked_env_files
from palisade.operators.report import remediation_brief
from palisade.operators.scoring import scorecard, union_findings
from palisade.operators.stacks import project_stacks
from palisade.operators.traffic import eligible_env_values, traffic_findings
from palisade.plans.shared_scan import shared_scan
from palisade.sources.commits import commit_lines
from palisade.sources.files import projects_of, with_name_parts


@dataclass
class Fleet:
    """Input tables.  ``files`` is required; an absent table leaves out the scans that read it."""

    files: DataFrame
    commits: DataFrame | None = None
    tracked: DataFrame | None = None
    responses: DataFrame | None = None
    traffic: DataFrame | None = None
    pages: DataFrame | None = None
    probes: DataFrame | None = None

    def __post_init__(self):
        self.files = with_name_parts(self.files)

    @cached_property
    def scanned(self) -> DataFrame:
        """The files after the shared scan; running it is the one job that reads all contents for the row-local scans."""
        return shared_scan(self.files)


def fleet_findings(fleet: Fleet, broadcast: bool | None = None) -> DataFrame:
    """Findings of every scan whose input is present.

    Contents of files are read twice: once by the shared scan, which is written, and once by the search for environment values.
    """
    scanned = fleet.scanned
    env_vars = env_values(scanned)
    scans = [
        env_findings(scanned), vault_files(scanned), missing_env_template(scanned),
        ignore_coverage(scanned), code_findings(scanned, project_stacks(scanned)),
        hardcoded_env_values(fleet.files, env_vars, broadcast),
    ]
    if fleet.commits is not None:
        scans.append(commit_findings(commit_lines(fleet.commits)))
    if fleet.tracked is not None:
        scans.append(tracked_env_files(fleet.tracked))
    if fleet.responses is not None:
        scans.append(header_findings(fleet.responses))
    stores = datastore_list(scanned, fleet.responses)
    scans += [datastore_hints(stores), client_key_exposure(stores)]
    if fleet.probes is not None:
        tables = tables_to_probe(projects_of(scanned), table_references(scanned))
        scans.append(open_table_findings(credential_dedup(credential_inventory(env_vars)), tables, fleet.probes))
    if fleet.traffic is not None:
        patterns = eligible_env_values(last_env_value(env_vars))
        scans.append(traffic_findings(fleet.traffic, patterns, fleet.pages, broadcast))
    return union_findings(*scans)


def fleet_report(fleet: Fleet, findings: DataFrame) -> dict[str, DataFrame]:
    """Report tables derived from (stored) findings."""
    projects = projects_of(fleet.scanned)
    scores = scorecard(projects, findings)
    return {
        "scorecard": scores,
        "profile": datastore_profile(fleet.scanned, fleet.responses),
        "brief": remediation_brief(findings, scores, project_stacks(fleet.scanned)),
    }
