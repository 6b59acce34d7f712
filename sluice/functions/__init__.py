"""Column functions (JVM-side expressions) and the small driver-side name rules."""
