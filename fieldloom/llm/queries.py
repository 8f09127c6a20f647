"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .common import table
from .ctw import op8_query
from .decontam import ORACLE_SQL as DECONTAMINATION_SQL
from .decontam import contaminated
from .gif import op3_query
from .html import extract_main_text
from .langid import op2_query
from .mixing import mix
from .neardup import ORACLE_SQL as NEAR_DUPLICATE_SQL
from .neardup import near_duplicates
from .packing import op11_query
from .pii import op1_query
from .runs import op13_query
from .search import ORACLE_SQL as SEARCH_SQL
from .search import search
from .toolcalls import op6_query
from .toxicity import op4_query

QUERIES = {
    "op1_pii": lambda spark, d: op1_query(table(spark, d, "documents")),
    "op2_langid": lambda spark, d: op2_query(table(spark, d, "documents")),
    "op3_gif": lambda spark, d: op3_query(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: op4_query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_superminhash": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op6_toolcalls": lambda spark, d: op6_query(spark, table(spark, d, "conversations")),
    "op7_mixing": lambda spark, d: mix(table(spark, d, "documents")).drop("source"),
    "op8_ctw": lambda spark, d: op8_query(table(spark, d, "documents")),
    "op9_decontamination": lambda spark, d: contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_html": lambda spark, d: extract_main_text(table(spark, d, "pages")),
    "op11_packing": lambda spark, d: op11_query(table(spark, d, "documents")),
    "op12_search": lambda spark, d: search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_runs": lambda spark, d: op13_query(table(spark, d, "documents")),
}
ORACLE: dict[str, str] = {"op5_superminhash": NEAR_DUPLICATE_SQL, "op9_decontamination": DECONTAMINATION_SQL,
    "op12_search": SEARCH_SQL}
