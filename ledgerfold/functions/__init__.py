"""Column expressions (JVM-side, codegen-friendly): casts, scalar maths, text."""
