"""§2.O: the scalar functions as SQL functions of a session, and documents' nodes as a table function.

A function is its Column expression written as SQL, so it runs within the JVM,
is optimised with the query around it, and is the same in both APIs.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ctispark.functions import ioc, text

#: By name: parameters (name and type) and the Column function of them.
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "refang": ("v string", ioc.refang), "detect_ioc_type": ("v string", ioc.detect_type), "infer_ioc_type": ("v string", ioc.infer_type), "infer_ioc_type_near": ("v string, hint string", ioc.infer_type), "looks_like_filepath": ("v string", ioc.looks_like_filepath),
    "public_ip": ("v string", ioc.public_ip), "is_domain": ("v string", ioc.is_domain), "is_email": ("v string", ioc.is_email), "is_url": ("v string", ioc.is_url), "is_registry_key": ("v string", ioc.is_registry_key), "is_filepath": ("v string", ioc.is_filepath),
    "ioc_well_formed": ("kind string, v string", ioc.well_formed), "ioc_status": ("kind string, v string, allowed boolean", ioc.status), "registerable_domain": ("d string", ioc.registerable_domain), "url_host": ("u string", ioc.url_host), "split_cell": ("v string", ioc.split_cell),
    "compound_token": ("v string", ioc.compound_token), "csv_safe": ("v string", ioc.csv_safe), "stix_pattern": ("kind string, v string", ioc.stix_pattern), "cve_ids": ("t string", text.cve_ids), "technique_ids": ("t string", text.technique_ids), "d3fend_ids": ("t string", text.d3fend_ids),
    "technique_from_url": ("u string", text.technique_from_url), "technique_url": ("t string", text.technique_url), "cve_link_source": ("href string", text.cve_link_source), "cve_route": ("cve string, known boolean", text.cve_route), "cvss_labels": ("vector string", text.cvss_labels),
    "rule_format": ("t string", text.rule_format), "rule_name": ("t string, heading string, th string", text.rule_name), "clean_rule_text": ("t string", text.clean_rule_text), "alert_severity": ("title string", text.alert_severity), "normalize_date": ("s string", text.normalize_date),
    "last_segment": ("u string", text.last_segment), "published_date": ("t string, fallback string", text.published_date), "asset_type": ("u string", text.asset_type), "normalize_asset_url": ("u string", text.normalize_asset_url), "resolve_url": ("u string, base string", text.resolve_url),
    "strip_itok": ("u string", text.strip_itok), "safe_filename": ("u string", text.safe_filename), "tactic_slug": ("t string", text.tactic_slug), "is_heading": ("line string", text.is_heading), "is_noise": ("line string", text.is_noise), "actor_names": ("title string", text.actor_names),
    "alias_org": ("t string", text.alias_org), "sector_name": ("t string", text.sector_name), "strip_html": ("s string", text.strip_html), "quote_verified": ("quote string, body string", text.quote_verified), "unfence_json": ("s string", text.unfence_json), "summary_of": ("t string", text.summary_of),
    "content_kind": ("content binary", text.content_kind), "block_page": ("status int, body string", text.block_page), "challenge_page": ("header string, body string", text.challenge_page), "extracted_commands": ("json string", text.extracted_commands), "source_verified": ("v string, body string, state string", text.source_verified),
}
_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.DOTALL)
#: Operators are written as functions by their signs, which SQL reads between backticks.
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|[=<>!+\-*/%&|]|and|or|not)\(")


def sql_of(expression: Column) -> str:
    """A Column expression as SQL."""
    parts = _LITERAL.split(expression._jc.node().sql())
    return "".join(part if i % 2 else _OPERATOR.sub(r"`\1`(", part) for i, part in enumerate(parts))


@udtf(returnType="pos int, parent_pos int, tag string, attrs map<string,string>, text string, table_pos int, noise boolean, hidden boolean")
class HtmlNodes:
    """M0 as a table function of a document: select ... from pages, lateral html_nodes(html)."""

    def eval(self, html: str):
        from ctispark.operators.parse import document_rows

        for r in document_rows(html) if html else ():
            yield r["pos"], r["parent_pos"], r["tag"], r["attrs"], r["text"], r["table_pos"], r["noise"], r["hidden"]


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS temporary functions of the session, and html_nodes a table function; their names."""
    for name, (parameters, function) in FUNCTIONS.items():
        columns = [F.col(p.split()[0]) for p in parameters.split(", ")]
        spark.sql(f"create or replace temporary function {name}({parameters}) return {sql_of(function(*columns))}")
    spark.udtf.register("html_nodes", HtmlNodes)
    return [*FUNCTIONS, "html_nodes"]
