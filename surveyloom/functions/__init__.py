from surveyloom.functions.levels import Codebook, Levels
from surveyloom.functions.nulls import (blank_to_null, fifelse, fill_missing, in_set,
                                        sentinel_to_null, sentinel_to_value, update)
from surveyloom.functions.numeric import UnitRule, cut, decode_units, label_above, round_even

__all__ = ["Codebook", "Levels", "UnitRule", "blank_to_null", "cut", "decode_units", "fifelse",
           "fill_missing", "in_set", "label_above", "round_even", "sentinel_to_null",
           "sentinel_to_value", "update"]
