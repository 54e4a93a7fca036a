from strandline.plans.fixpoint import Known, bits, fixpoint, least
from strandline.plans.materialize import checkpoint_root, cut, few, forget, if_few, keyed, measured_joins, new_folder, path_exists
from strandline.plans.ordered import merge_spans, number_changes, number_free, order_slices, running_sum, top_per_project, with_previous
from strandline.plans.saturate import saturate

__all__ = ["Known", "bits", "checkpoint_root", "cut", "few", "fixpoint", "forget", "if_few", "keyed", "least", "measured_joins", "merge_spans", "new_folder", "number_changes", "number_free", "order_slices", "path_exists", "running_sum", "saturate", "top_per_project",
           "with_previous"]
