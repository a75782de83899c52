"""Variational autoencoder over sample vectors: model, scoring and data-parallel fitting."""

from fluxloom.operators.vae.model import Vae
from fluxloom.operators.vae.scoring import Scorer, SparseRows

__all__ = ["Scorer", "SparseRows", "Vae"]
