"""Encoders: columns to bits."""

from .base import Encoder
from .category import BooleanEncoder, CategoryEncoder, HierarchicalCategoryEncoder, OrdinalEncoder, SetEncoder
from .composite import MultiEncoder
from .finance import CurrencyPairEncoder, OrderBookEncoder, PriceEncoder
from .network import IpAddressEncoder, MacAddressEncoder
from .numeric import DeltaEncoder, LogEncoder, PassThroughEncoder, RandomDistributedScalarEncoder, ScalarEncoder
from .probability import ConfidenceIntervalEncoder, DistributionEncoder
from .signal import AccelerometerEncoder, EcgEncoder, HrvEncoder, PitchEncoder, SpectrogramEncoder, WaveformEncoder
from .spatial import CoordinateEncoder, GeospatialEncoder, GridCellEncoder
from .temporal import DateEncoder
from .text import CharacterEncoder, GraphNodeEncoder, LlmEmbeddingEncoder, NGramEncoder, PatchEncoder, SimHashDocumentEncoder, WordEmbeddingEncoder
from .vision import ColorEncoder, EdgeOrientationEncoder

__all__ = [n for n in dir() if n.endswith("Encoder")]
