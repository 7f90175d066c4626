from .core import full, lagged, ratio, rows_back, settle, sym_order, tidy  # noqa: F401
from .lineage import cut, dealt  # noqa: F401
from .normal import norm_cdf, norm_ppf  # noqa: F401
from .uniform import below, bound, uniform  # noqa: F401
