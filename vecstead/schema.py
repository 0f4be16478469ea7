"""Schemas and the registry of measures."""

from __future__ import annotations

from dataclasses import dataclass

EMBEDDING = "rank bigint, word string, vec array<double>"
PREDICTIONS = "example_id bigint, pred int"
NER_LINES = "line_no bigint, token string, gold string, pred string"
RESULT_KEYS = ("algo", "seed", "dim", "lr", "bitrate", "compress_type", "space")

# Fixed values of the experiment grid.
SEEDS = (1234, 1235, 1236)
DIMS = (25, 50, 100, 200, 400, 800)
BITRATES = (1, 2, 4, 8, 16, 32)
EMBEDDING_LR = {"mc": 0.2, "w2v_cbow": 0.05, "glove": 0.01, "ft_sg": 0.05}
END_TAG = {"mc": "50.txt", "w2v_cbow": "50.w.txt", "glove": "050.w.txt"}
# The learning rate of each downstream model, by embedding; validation columns (`_val`) share them.
DOWNSTREAM_LR = {
    "mc": {"la_sst": 0.001, "la_mr": 0.1, "la_subj": 0.1, "la_mpqa": 0.001, "rnn_no_crf_ner": 1.0},
    "w2v_cbow": {"la_sst": 0.0001, "la_mr": 0.001, "la_subj": 0.0001, "la_mpqa": 0.001, "rnn_no_crf_ner": 0.1},
    "glove": {"la_sst": 0.01, "la_mr": 0.01, "la_subj": 0.01, "la_mpqa": 0.001, "rnn_no_crf_ner": 1.0},
    "ft_sg": {"la_sst": 0.001, "la_mr": 0.01, "la_subj": 100.0, "la_mpqa": 0.01, "rnn_no_crf_ner": 1.0},
}


@dataclass(frozen=True)
class Measure:
    """A measure's canonical column, the other names it goes by in result files, and which way is stable."""

    name: str
    aliases: tuple[str, ...]
    higher_is_stable: bool = False


MEASURES = (
    Measure("eis", ("anchor_eigen_overlap_3.0_top_10000", "eis_3.0_top_10000")),
    Measure("knn", ("knn_top_10000_nquery_1000_nn_5",), True),
    Measure("sem_disp", ("sem_disp_top_10000",)),
    Measure("pip", ("pip_top_10000",)),
    Measure("eigen_overlap", ("eigen_overlap_top_10000",), True),
    Measure("fro_norm", ("fro_norm_top_10000",)),
)
BY_NAME = {alias: m for m in MEASURES for alias in (m.name, *m.aliases)}


def higher_is_stable(name: str) -> bool:
    return name in BY_NAME and BY_NAME[name].higher_is_stable
