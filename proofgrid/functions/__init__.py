"""Column functions: scalars and bits in generated code, pixel kernels in Arrow batches."""
