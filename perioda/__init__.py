"""Time series and econometric models on Spark: the names most users need."""

from .functions.periods import FREQUENCIES, frequency
from .model.data import Data, evaluate_expression
from .model.estimate import Estimates, chow_test, estimate
from .model.expr import Binary, Call, MdlError, MdlSyntaxError, Number, Unary, Variable, parse_expression, temporal_offsets, variable_names
from .model.expr import offsets as variable_offsets
from .model.parse import Model, load_model, parse_mdl
from .model.simulate import (
    ESTIMATE,
    LOAD_MODEL_DATA,
    MULTMATRIX,
    OPTIMIZE,
    RENORM,
    SIMULATE,
    STOCHSIMULATE,
    Bound,
    BoundModel,
    Disturbance,
    MultiplierError,
    Multipliers,
    OptimizationError,
    Optimum,
    Renormalization,
    RenormalizationError,
    Simulation,
    Stochastic,
    Timed,
    bind_model_data,
    multiplier_matrix,
    optimize_model,
    renormalize,
    simulate,
    stochastic_simulate,
)
from .model.solve import Block, ConvergenceError
from .operators.api import *  # noqa: F403
from .operators.frame import TsFrame
from .operators.resample import convert as convert_frequency
from .sources.exchange import from_pandas, load, read_text, save, to_pandas, write_text

LOAD_MODEL = load_model
CSV2TS, TS2CSV = read_text, write_text
__all__ = [n for n in globals() if not n.startswith("_")]
