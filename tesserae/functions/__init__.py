"""Scalar building blocks: vectors, matrices, quaternions as column expressions; byte ciphers as expressions and Arrow kernels."""
