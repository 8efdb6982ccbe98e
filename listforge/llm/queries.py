"""Queries of the training-data operators, by name."""

from __future__ import annotations

from .counts import op8
from .decontaminate import OP11_SQL, op11
from .media import op1
from .merkle import OP12_SQL, op12
from .ngram_join import op10
from .packing import op5
from .quality import op3
from .records import op6
from .secrets import op7
from .sharding import op9
from .toxicity import op4
from .whitening import op13
from .wordtable import op2

QUERIES = {
    "op1_gif_media": op1,
    "op2_word_table_bpe": op2,
    "op3_quality_rules": op3,
    "op4_noisy_channel_toxicity": op4,
    "op5_configuration_packing": op5,
    "op6_record_files": op6,
    "op7_secret_scan": op7,
    "op8_edit_token_counts": op8,
    "op10_ngram_lsh_forest": op10,
    "op9_histogram_sort_shards": op9,
    "op11_benchmark_decontamination": op11,
    "op12_merkle_manifest": op12,
    "op13_embedding_whitening": op13,
}

#: DuckDB SQL for those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op11_benchmark_decontamination": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
