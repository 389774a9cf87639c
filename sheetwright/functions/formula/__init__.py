"""The spreadsheet formula language: a parser, a compiler to Spark columns and a cell-graph kernel."""

from .compile import aggregate_formulas, compile_formula, with_formulas
from .kernel import recalculate, recalculate_frame
from .parse import FormulaError, parse

__all__ = ["FormulaError", "aggregate_formulas", "compile_formula", "parse", "recalculate", "recalculate_frame", "with_formulas"]
