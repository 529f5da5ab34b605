"""Part of pcgspark; see the package README."""
