"""The content-filter language: text to syntax tree to Column."""

from streamroute.operators.filters.compile import StructFields, VariantFields, compile_filter, condition
from streamroute.operators.filters.interp import evaluate
from streamroute.operators.filters.syntax import FilterEnd, FilterError, FilterParse, FilterToken, parse

__all__ = ["FilterEnd", "FilterError", "FilterParse", "FilterToken", "StructFields", "VariantFields", "compile_filter", "condition", "evaluate", "parse"]
