"""Column builders: geodesy, sight lines, cameras, cells, text and sensors. All stay inside whole-stage code generation."""
